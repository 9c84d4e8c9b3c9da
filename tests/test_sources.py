"""JSON lines, postings and pages on small literal inputs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.operators import lifecycle
from parcela.sources import elements, jsonl, pages, postings


def test_jsonl_skips_bad_lines_and_appends_new_ids(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": \n{"id": "b", "n": 2}\n')
    rows = jsonl.scan(spark, f"file://{tmp_path}/in.jsonl", "id STRING, n INT")
    assert sorted(r["id"] for r in rows.collect()) == ["a", "b"]
    schema, out = T.StructType().add("id", "string").add("n", "integer"), f"file://{tmp_path}/out"
    jsonl.append_new(rows, out, "id", schema)
    jsonl.append_new(rows.unionByName(spark.createDataFrame([("c", 3), ("c", 3)], schema)), out, "id", schema)
    assert sorted(r["id"] for r in spark.read.schema(schema).json(out).collect()) == ["a", "b", "c"]


def test_posting_edges(spark):
    raw = [
        {"postingId": "", "id": " 7 ", "status": "SOLD", "expenses": {"amount": 0, "currency": "ARS"}, "priceOperationTypes": [], "mainFeatures": {"CFT1": {"value": "3.9"}, "CFT2": {"value": "x"}}},
        {"postingId": None, "id": None}, {"postingId": "8", "realEstateType": {"realEstateTypeId": "33"}}, {"postingId": "9\u0000", "modified_date": "1999-01-01T00:00:00-0400"},
    ]
    rows = spark.createDataFrame([(json.dumps(x),) for x in raw] + [("not json",), (None,)], "posting string")
    got = {r["external_id"]: r for r in postings.normalize(rows).collect()}
    assert set(got) == {"7", "9"} or set(got) == {"7", "9\x00"}
    r = got["7"]
    assert (r["status"], r["expenses_amount"], r["expenses_currency"], r["price_amount"], r["rooms"], r["bedrooms"]) == ("unknown", None, None, None, 3, None)
    assert r["canonical_url"] == "https://portal.example/propiedades/7.html" and r["extra_data"] is None


def test_pages_without_anything(spark):
    blank = spark.createDataFrame([(1, "u", ""), (2, None, None)], "id int, url string, html string")
    row = pages.generic(blank).where("id = 1").first()
    assert row["layout"] is None and row["price"] is None
    assert pages.features(blank).count() == 0 and pages.next_data_links(blank).count() == 0 and pages.links(blank, "https://x").count() == 0
    assert pages.assemble(blank).count() == 2
    assert pages.body_text(spark.createDataFrame([(1, "u", "<p>1.250,5 m²</p>")], "id int, url string, html string")).first()["body_surface"] is None


def test_published_days(spark):
    texts = {"Publicado hace 3 días": 3, "Publicado hoy": 0, "Publicado ayer": 1, "hace 5 horas": 0, "hace 2 meses": 60, "hace más de 1 año": 365, "sin fecha": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pages.published_days(F.col("t")).alias("d"))
    assert {r["t"]: r["d"] for r in rows.collect()} == texts


def test_null_payload_overwrites_on_change(spark):
    cur = spark.createDataFrame([(1, "a", "active", 5, "1998-01-01", "1998-01-01", "1998-01-01")], "source_id int, external_id string, status string, rooms int, first_seen_at string, last_seen_at string, last_changed_at string")
    new = spark.createDataFrame([(1, "a", "paused", None, 0, 0)], "source_id int, external_id string, status string, rooms int, page int, position int")
    row = lifecycle.merge(cur, new, F.lit("1999-01-01")).first()
    assert (row["status"], row["rooms"], row["first_seen_at"], row["last_changed_at"]) == ("paused", None, "1998-01-01", "1999-01-01")


def _page(spark, html):
    return spark.createDataFrame([(1, "u", html)], "id int, url string, html string")


def test_json_ld_rules(spark):
    block = lambda d: f'<script type="application/ld+json">{json.dumps(d)}</script>'
    got = pages.ld_json(_page(spark, block({"@type": "House", "offers": {"price": "120000.9"}, "address": {"addressRegion": "Caballito"}, "datePublished": "1999-05-01"}) + "<script type='application/ld+json'>[1]</script>")).first()
    assert (got["price"], got["currency"], got["address"], got["kind"], got["posted"]) == (120000, "USD", None, "Casa", "1999-05-01")
    got = pages.ld_json(_page(spark, block({"@type": "Product", "offers": {"price": 5, "priceCurrency": "ARS"}, "address": {"streetAddress": " Calle 1 ", "addressRegion": ""}, "floorSize": {"value": "45.5"}}) + block({"@type": "apartment", "offers": {"price": 0}}))).first()
    assert (got["price"], got["address"], got["kind"], got["surface"]) == (None, "Calle 1", "Departamento", 45.5)
    made = {"@type": "Apartment", "name": "Depto 2 amb - Portal", "numberOfBedrooms": "2", "numberOfBathroomsTotal": 1, "description": " d ", "address": {"streetAddress": "Rivadavia 1", "addressRegion": "Flores", "addressLocality": "Capital Federal, Argentina, "}}
    got = pages.ld_property(_page(spark, block({"@type": "Product"}) + block(made))).first()
    assert tuple(got[f"ld_{c}"] for c in ("title", "description", "bedrooms", "bathrooms", "street", "city", "province", "country", "neighborhood")) == ("Depto 2 amb", "d", 2, 1, "Rivadavia 1", "Capital Federal", "Capital Federal", "Argentina", "Flores")
    days = spark.createDataFrame([("1999-05-01",), ("1999-05-30T00:00:00Z",), ("x",), ("2001-01-01",)], "p string").select(pages.market_days(F.col("p"), F.lit("1999-05-31T12:00:00Z").cast("timestamp")))
    assert [r[0] for r in days.collect()] == [30, 1, None, 0]


def test_price_blocks(spark):
    cases = {
        '<div class="price-value"><span>Alquiler  temporal</span> <b>USD 1.500</b></div>': ("alquiler temporal", "USD", 1500), '<p class="block-price-container x">venta $ 90.000,5</p>': ("venta", "ARS", 90000),
        '<div class="price-items">Consultar</div>': (None, None, None), "<div>venta USD 5</div>": (None, None, None),
    }
    for html, want in cases.items():
        got = pages.price_block(_page(spark, html)).first()
        assert (got["operation"], got["block_currency"], got["block_amount"]) == want


def test_body_text_rules(spark):
    got = pages.body_text(_page(spark, "<p>USD 500 o USD 95.000 Antigüedad 12, 60 m2 totales 10,5 m² semicubiertos 30 m² Orientación: NE piso 4 pileta</p>")).first()
    assert (got["body_price"], got["body_age"], got["body_surface"], got["body_semi"], got["body_orientation"], got["body_floor"], got["body_pool"], got["body_garage"]) == (95000, None, 60.0, 10.5, "Norte", 4, True, False)
    got = pages.body_text(_page(spark, "<p>20 años de antiguedad, 45,5 m² cubiertos, cocheras</p>")).first()
    assert (got["body_age"], got["body_surface"], got["body_garage"]) == (20, 45.5, False)


def test_sellers(spark):
    kinds = {"/inmobiliarias/a": "inmobiliaria", "/CORREDORES/b": "corredor", "/desarrolladores/c": "desarrollador", "/constructoras/d": "desarrollador", "/particulares/e": "particular", "/usuarios/f": None}
    cases = {f'<a href="{href}" data-qa="seller-link"> <b>N</b>  M</a>': ("N M", want) for href, want in kinds.items()} | {
        """<a data-qa="linkMicrositioAnuncianteLeads" href="/inmobiliarias/x">A</a><a data-qa='publisher' href='/particulares/'>B</a>""": ("A", "inmobiliaria"),
        "<a data-qa='myAnunciante' href='/x'>B</a>": ("B", None),
        '<section class="publisher-card"><p>x</p><span class="user-label">Empresa <i>constructora</i></span><div><a class="publisherCard-module__info-name___1" href="/u">C</a></div></section>': ("C", "inmobiliaria"),
        '<div class="publisherCard"><p class="type">Developer</p></div><a data-qa="seller-link">D</a>': ("D", None),
        '<div class="publisher-name"> </div><div class="publisherName"><b>E</b></div>': ("E", None), "<a href='/inmobiliarias/q'>F</a>": (None, None),
    }
    rows = spark.createDataFrame([(h, "u", h) for h in cases], "id string, url string, html string")
    assert {r["id"]: (r["seller_name"], r["seller_type"]) for r in pages.seller(rows).collect()} == cases


def test_pictures_icons_and_features(spark):
    html = 'avisos/1/00/12/34/56/360x266/7.jpg avisos/2/00/12/34/56/x/7.jpg avisos/1/00/12/34/56/x/8.jpg avisos/1/00/12/34/57/x/9.jpg'
    assert _page(spark, html).select(pages.picture_count(F.col("html"), F.lit("123456")), pages.picture_count(F.col("html"), F.lit("12345"))).first() == (2, None)
    icons = """<ul><li>1.250,5 m² <i class="icon-stotal x"></i></li><li><b><i class="icon-bano"></i></b><span>2</span> baños</li><li><i class='icon-toilet'></i>1</li><li><i class="icon-antiguedad"></i>A estrenar</li></ul>
      <p><i class="icon-orientacion"></i><b>Norte</b></p><span><i class="icon-ambientes"></i>9</span>"""
    got = pages.icon_features(_page(spark, icons)).first()
    assert (got["icon_total"], got["icon_bathrooms"], got["icon_toilettes"], got["icon_age"], got["icon_orientation"], got["icon_rooms"]) == (1250.5, 2, 1, 0, "Norte", None)
    made = {
        "A": {"1": {"label": " Aire  Acondicionado! ", "value": None}, "2": {"label": "x", "value": "0"}, "3": {"label": "Baños", "value": "2", "icon": "bano"}, "4": {"label": "Nota", "value": "a};b", "measure": "m"}, "5": {"label": "Pisos", "value": 12}},
        "B": {"6": {"label": "Frente", "value": "8,5", "measure": "m"}, "7": {"label": "", "value": "1"}, "8": {"label": "Fondo", "value": "1.250"}, "9": {"label": "Alto", "value": "1.2.3"}, "10": {"label": "nota", "value": "b"}},
    }
    got = [(r["key"], r["value"]) for r in pages.features(_page(spark, f"<script>const generalFeatures = {json.dumps(made, ensure_ascii=False)}; var x = {{}};</script>")).collect()]
    assert sorted(got) == [("aire_acondicionado", "true"), ("alto", "12.3"), ("fondo", "1.25"), ("frente", "85"), ("nota", "b"), ("pisos", "12")]


def _general(spark, *scripts: str) -> list[list[tuple[str, str]]]:
    rows = spark.createDataFrame([(i, "u", f"<script>{x}</script>") for i, x in enumerate(scripts)], "id int, url string, html string")
    got = pages.features(rows).collect()
    return [sorted((r["key"], r["value"]) for r in got if r["id"] == i) for i in range(len(scripts))]


def test_a_general_features_last_value_counts(spark):
    """One row a key, as the portal's features are one dict; a feature that is left out replaces none."""
    note, pool = {"label": "Nota", "value": "a};b", "measure": "m"}, {"label": "Pileta", "value": None}
    made = [
        {"A": {"1": note}, "B": {"2": pool}}, {"A": {"1": note}, "B": {"2": {"label": "nota!", "value": "z"}}}, {"A": {"1": note, "2": {"label": "Nota", "value": "0"}, "3": {"label": "Nota", "value": "9", "icon": "bano"}}},
    ]
    got = _general(spark, *[f"const generalFeatures = {json.dumps(x)};" for x in made])
    assert got == [[("nota", "a};b m"), ("pileta", "true")], [("nota", "z")], [("nota", "a};b m")]]


def test_general_features_beside_what_is_no_object(spark):
    """Only the section or feature that is no object is passed over, not the page's others."""
    a, b = {"label": "Nota", "value": "x", "measure": "m"}, {"label": "Pisos", "value": 2}
    made = [{"A": odd, "B": {"1": a, "2": b}} for odd in ("x", [a], 5, None)] + [{"A": {"1": a, "0": odd}, "B": {"2": b}} for odd in ("x", [a], 5, None)]
    got = _general(spark, *[f"generalFeatures={json.dumps(x)}; var x = {{}};" for x in made], "generalFeatures = {", "generalFeatures = {'A': oops};")
    assert got == [[("nota", "x m"), ("pisos", "2")]] * len(made) + [[], []]


def test_general_features_are_the_first_object_assigned(spark):
    """As in the portal: not a list, a property of that name, or null; a longer name counts."""
    one, other = ('{"A": {"1": {"label": "%s", "value": "1"}}}' % x for x in ("Uno", "Dos"))
    scripts = [
        f"generalFeatures = []; generalFeatures = {one}; generalFeatures = {other};", f'x = {{"generalFeatures": {{}}}}; const generalFeatures = {one};', f"x = {{generalFeatures: {other}}}; generalFeatures\n=\n{one}",
        f"var generalFeatures = null; generalFeatures = {one};", f"var my_generalFeatures = {one};", f'x = {{"generalFeatures": {one}}}',
    ]
    assert _general(spark, *scripts) == [[("uno", "1")]] * len(scripts)
    rows = spark.createDataFrame([("https://portal.example/propiedades/clasificado/casa-1.html", f"<script>{x}</script>") for x in scripts], "url string, html string")
    assert [r["feature_sections"] for r in pages.assemble(rows).collect()] == [1] * len(scripts)


def test_element_tree(spark):
    html = """<!-- <p>no</p> --><DIV Class='a  b' data-x=1><p>one &amp; <br>two<li>three</p><script>var s = "<p>four</p>";</script></div></span>tail <b title="x > y">five"""
    nodes, texts = elements.elements(html)
    assert [(n["tag"], n["parent"]) for n in nodes] == [("div", None), ("p", 0), ("br", 1), ("li", 1), ("script", 0), ("b", None)]
    assert dict(nodes[0]["attrs"]) == {"class": "a  b", "data-x": "1"} and dict(nodes[5]["attrs"]) == {"title": "x > y"}
    inside = lambda n: [t["text"].strip() for t in texts if n["start"] <= t["at"] <= n["stop"] and not t["raw"]]
    assert inside(nodes[0]) == inside(nodes[1]) == ["one &", "two", "three"] and inside(nodes[5]) == ["five"] and inside(nodes[4]) == []
    assert elements.elements("") == ([], []) and elements.elements("a < b")[1][0]["text"] == "a < b"
    t, rows = elements.Tree(), elements.with_tree(spark.createDataFrame([(html,), (None,)], "html string"))
    got = rows.select(t.body().alias("body"), t.text(t.around(t.first(elements.tagged("li")), elements.tagged("div"))).alias("card"), t.text(t.first(elements.of_class("b"), elements.tagged("b"))).alias("b"), F.size(t.inside(t.first(elements.tagged("p")), lambda n: F.lit(True))).alias("n")).collect()
    assert [tuple(r) for r in got] == [("one & two three tail five", "one & two three", "one & two three", 2), ("", None, None, 0)]


def test_script_literals():
    page = """<script>const antiquity='Publicado \\'hoy\\''; x.publisher = {"a": "}", 'b': ['{']}; var publisherId = {"z": 1}; "visibility" : "EXACT"; videos = [1, "]"]; tier=="3"; latitude: -34.5e, longitude = '7'; usersViews = abc; publisher = {"open": 1</script>"""
    got = [(v["name"], v["quoted"], v["kind"], v["text"]) for v in elements.literals(page)]
    assert got == [
        ("antiquity", False, "s", "Publicado 'hoy'"), ("publisher", False, "o", """{"a": "}", 'b': ['{']}"""), ("visibility", True, "s", "EXACT"), ("videos", False, "o", '[1, "]"]'), ("latitude", False, "n", "-34.5"), ("longitude", False, "s", "7"),
    ]


def test_inline_variables(spark):
    far = " " * 500
    cases = {
        "<script>const antiquity = 'Publicado hace 5 días'; const usersViews = 77; latitude: -346037220; Longitude = \"-58.38\"</script>": (5, 77, -34.603722, -58.38, None, None, None, False, False, None),
        """<script>const antiquity = 'hace más de 1 año'; publisher = {"publisherId": 0, "license": "", "urlLogo": "https://l"}; tier: '3', m = {'1': 'simple'}; "visibility": "hidden"; const videos = ["a"]; tour360Url = "http://x"</script>""": (365, None, None, None, "superdestacado", None, "https://l", True, False, "HIDDEN"),
        f"""<script>tier = 2;{far}m = {{'1' : 'simple'}}; publisher={{"publisherId": 12, "license": "M1"}}; "videoUrl": "https://v", "tourUrl" : "https://t"; const antiquity = "hoy"; "latitude": 5</script>""": (0, None, None, None, None, "12", None, True, True, None),
        "<script>const antiquity = 'hace 3 horas'</script>": (0, None, None, None, None, None, None, False, False, None), "": (None, None, None, None, None, None, None, False, False, None),
    }
    rows = spark.createDataFrame([(h, "u", h) for h in cases], "id string, url string, html string")
    got = {r["id"]: tuple(r[c] for c in ("days", "views", "lat", "lon", "publication_tier", "seller_id", "seller_logo", "has_video", "has_tour_360", "visibility")) for r in pages.inline_variables(rows).collect()}
    assert got == cases


def test_next_data_and_hidden_input(spark):
    script = lambda d: f'<script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": d}})}</script>'
    cases = [
        ({"listing": {}, "posting": {"price": {"amount": 0, "value": "95000.7", "currency": "ARS"}, "geo": {"lat": -346037000, "lon": "-58.38"}}}, (95000, "ARS", -34.6037, -58.38)),
        ({"listing": {"geo": {"lat": -34.6}, "location": {"latitude": -30.0, "longitude": -60.0}}}, (None, None, -30.0, -60.0)), ({"listing": [1], "posting": {"geo": {"lat": 0, "lon": 5}, "coordinates": {"lat": 1, "lon": 2}}}, (None, None, 1.0, 2.0)),
        ({"initialData": {"listing": {"prices": [{"amount": None}, {"value": 7}]}}}, (7, "USD", None, None)), ({"listing": {"priceOperationType": {"prices": [{"amount": 3, "currency": "ARS"}]}}}, (3, "ARS", None, None)), ({"x": 1}, (None, None, None, None)),
    ]
    for made, want in cases:
        got = pages.next_data(_page(spark, script(made))).first()
        assert (got["next_price"], got["next_currency"], got["next_lat"], got["next_lon"]) == want
    ld = lambda d: f'<script type="application/ld+json">{json.dumps(d)}</script>'
    fields = ("hidden_price", "hidden_currency", "hidden_kind", "covered", "uncovered", "hidden_age", "hidden_orientation", "hidden_floor", "hidden_garage", "hidden_pool", "hidden_address", "hidden_posted")
    cases = {
        """<input type="hidden" data-moneda="usd" data-price='85000.5' data-tipo-propiedad="oficina" data-barrio="Flores" data-localidad=""><div class="x property-features"><b>Sup. Total:</b> 90,5 Sup. <i>Cubierta</i> 60 Sup Semicubierta: 10 Antigüedad: 8 Orientación: noreste Piso 4 Cochera</div>""": (85000, "USD", "Local", 60.0, 20.5, 8, "Norte", 4, True, None, "Flores", None),
        '<p class="card-price">desde USD 500</p><p class="titlebar__price">consultar <b>$ 95.000</b></p><p class="card-price">USD 120.000</p>' + ld({"@type": "VideoObject", "uploadDate": "1999-05-02"}): (95000, "ARS", None, None, None, None, None, None, None, None, None, "1999-05-02"),
        '<input data-price="0" data-barrio="B"><p class="card-price">USD 500 $ 2.000</p>' + ld({"@type": "House", "address": {"streetAddress": "Mitre 1", "addressRegion": "R"}, "floorSize": {"value": 70}, "datePosted": "1999-01-01"}) + ld({"@type": "Apartment", "datePublished": "1999-02-01"}): (2000, "ARS", "Casa", 70.0, None, None, None, None, None, None, "Mitre 1, R", "1999-02-01"),
    }
    rows = spark.createDataFrame([(h, "u", h) for h in cases], "id string, url string, html string")
    assert {r["id"]: tuple(r[c] for c in fields) for r in pages.hidden_inputs(rows).collect()} == cases


def test_rendered_pages(spark):
    fields = ("shown_price", "shown_address", "shown_covered", "shown_semi", "shown_kind", "shown_age", "shown_orientation", "shown_floor", "shown_garage", "shown_pool")
    cases = {
        '<h1>PH con local</h1><div class="ui-pdp-media__title">ubicacion Belgrano, , Capital Federal, Capital Federal VER INFORMACION de la zona</div><p class="big-price">U$S 95.000</p><p>80 m² totales 10 m² semicubiertos, 12 años de antigüedad, orientación Sur, piso: 3, cochera</p>': (95000, "Belgrano, Capital Federal", 80.0, 10.0, "PH", 12, "Sur", 3, True, None),
        '<script type="application/ld+json">{"@type":"Place"}</script><script type="application/ld+json">{"@type":"Product","offers":{"price":"70000","priceCurrency":"ARS"},"address":{"streetAddress":"Mitre 10"}}</script><p class="price-tag">USD 800 o USD 80.000</p><p class="x price">USD 81.000</p><p class="location">Otra calle</p>': (81000, "Mitre 10", None, None, None, None, None, None, None, None),
        '<p class="location">abc</p><p class="my-location">Av. Rivadavia 100</p><b>departamento</b> casa 45,5 m2 cubiertos 50 m² totales piscina': (None, None, 45.5, None, "Departamento", None, None, None, None, True),
    }
    rows = spark.createDataFrame([(h, "u", h) for h in cases], "id string, url string, html string")
    assert {r["id"]: tuple(r[c] for c in fields) for r in pages.rendered(rows).collect()} == cases


def test_assembly_order(spark):
    ld = json.dumps({"@type": "House", "name": "LD - Portal", "offers": {"price": 90000}, "floorSize": {"value": 50}, "numberOfBedrooms": 0, "geo": {"latitude": -30.0, "longitude": 0}, "address": {"streetAddress": "Mitre 1"}})
    html = f"""<script type="application/ld+json">{ld}</script><script>longitude = -58.5; latitude = -35.5</script><div class="price-value"><div>Venta</div> <span>USD 120.000</span></div><li><i class="icon-dormitorio"></i>3</li>
      <div class="post-antiquity"><p>Publicado hace 2 meses</p></div><div class="wrapper-description"><b>uno</b><br><i>dos</i></div>"""
    got = pages.assemble(_page(spark, html)).first()
    assert (got["price"], got["price_currency"], got["surface_total"], got["bedrooms"], got["lat"], got["lon"], got["title"], got["days"], got["description"], got["address"], got["operation"]) == (120000, "USD", None, 3, -30.0, -58.5, "LD", 60, "uno\ndos", "Mitre 1", "venta")
    blank = pages.assemble(_page(spark, None)).first()
    assert blank["price"] is None and blank["title"] is None and blank["has_video"] is False


def test_portal_links(spark):
    cases = {
        "https://www.argenprop.com/x": ("""<script>window.__INITIAL_STATE__ = {"a": ["https:\\/\\/www.argenprop.com\\/casa-en-venta--1", "https://www.argenprop.com/otra"]};</script><a href="/ph-x">p</a>""", ["https://www.argenprop.com/casa-en-venta--1"]),
        "https://argenprop.com/y": ("<a href='/ph-x?a'>p</a><a href='/ph-x#b'>p</a><a href=/local-z>q</a>", ["https://www.argenprop.com/ph-x", "https://www.argenprop.com/local-z"]),
        "https://www.buscainmueble.com/": ('<a href="/casa-10">a</a><a href="/aviso/casa-11?x">b</a>', ["https://www.buscainmueble.com/aviso/casa-11"]), "https://www.inmuebles.clarin.com/": ('<a href="/casa/x-10.html">a</a>', ["https://www.inmuebles.clarin.com/casa/x-10.html"]),
        "https://mercadolibre.com/p": ("<a href='https://x.mercadolibre.com.ar/MLA-1'>a</a>", None), "https://mercadolibre.com/MLA": ("<a href='https://x.mercadolibre.com.ar/MLA-1#c'>a</a><a href='https://x.mercadolibre.com.ar/list?MLA-2'>a</a>", ["https://x.mercadolibre.com.ar/MLA-1"]),
    }
    rows = spark.createDataFrame([(u, h) for u, (h, _) in cases.items()], "url string, html string")
    got: dict = {}
    for r in pages.portal_links(rows).orderBy("url", "position").collect():
        got.setdefault(r["url"], []).append(r["link"])
    assert got == {u: w for u, (_, w) in cases.items() if w}


def test_posting_link_where_the_url_is_empty(spark):
    raw = [{"postingId": "1", "url": "", "link": "/a.html"}, {"postingId": "2", "link": "https://x.example/b"}, {"postingId": "3", "url": "/c.html", "link": "/d.html"}]
    rows = spark.createDataFrame([(json.dumps(x),) for x in raw], "posting string")
    assert {r["external_id"]: r["canonical_url"] for r in postings.normalize(rows).collect()} == {"1": "https://portal.example/a.html", "2": "https://x.example/b", "3": "https://portal.example/c.html"}


def test_icon_portal_rules(spark):
    cases = {
        '<p class="miniinfo"><span><img src="a/ico_precio_us.png"> U$S 49.700</span><span><img src="ico_mt2cub.png"/> 62,5 m2</span><span><img src="ico_cocheras.png"> 2</span><span><img src="ico_dire.png"> <b>San Juan</b>  10</span></p>': (49700, 62.5, True, "San Juan 10"),
        """<meta name="description" content="Casa u$s120,000"><span><img src="ico_precio_us.png"> 99</span><span><img src="ico_cocheras.png">--</span><script>x = {ubicacion: 'Mitre 5'}</script>""": (120000, None, False, "Mitre 5"),
        '<span><img src="ico_cocheras.png">0</span>': (None, None, False, None),
    }
    for html, want in cases.items():
        got = pages.icon_images(_page(spark, html)).first()
        assert (got["image_price"], got["image_covered"], got["image_garage"], got["image_address"]) == want


def test_image_and_address_fallbacks(spark):
    cases = {
        '<meta property="og:image" content="https://a/1.jpg"><div class="gallery"><img src="https://a/2.jpg"></div>': ("https://a/1.jpg", None),
        '<div class="photo-slider"><img src="data:x" data-src="https://a/3.jpg"></div><h2 data-qa="posting-location"> Mitre  10, <b>Rosario</b></h2>': ("https://a/3.jpg", "Mitre 10, Rosario"),
        '<div class="section-location">' + "x" * 150 + '</div><meta property="og:title" content="Casa en venta en Fisherton - Rosario">': (None, "venta en Fisherton"),
        '<img src="https://a/4.jpg">': (None, None),
    }
    for html, want in cases.items():
        got = pages.address(pages.media(_page(spark, html))).first()
        assert (got["image"], got["page_address"]) == want
