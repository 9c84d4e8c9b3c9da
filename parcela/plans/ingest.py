"""Queries and oracle SQL of posting JSON and page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import spread, table
from ..sources import jsonl, pages, postings
from .views import ctes, view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


# Raw posting JSON, made from the listings by Spark, and read back.
_POSTING = """to_json(named_struct('postingId', case when id % 50 = 0 then '' else external_id end, 'id', case when id % 100 = 0 then '' else external_id end, 'url', case id % 3 when 0 then concat('/p-', external_id, '.html') when 1 then concat('https://other.example/', external_id) end,
  'status', upper(case status when 'active' then 'online' else status end), 'modified_date', concat('1999-05-0', id % 9 + 1, 'T10:00:00-0400'), 'generatedTitle', title,
  'realEstateType', named_struct('realEstateTypeId', string(id % 40), 'name', property_type),
  'priceOperationTypes', array(named_struct('operationType', named_struct('name', initcap(operation_type)), 'lowPricePercentage', case when id % 5 = 0 then 7.5D end, 'prices', array(named_struct('amount', double(price_amount), 'currency', price_currency)))),
  'expenses', named_struct('amount', case when id % 4 = 1 then double(expenses_amount) else 0.0D end, 'currency', 'ARS'),
  'mainFeatures', map('CFT1', named_struct('value', string(rooms), 'label', 'amb', 'measure', ''), 'CFT2', named_struct('value', concat(string(bedrooms), '.9'), 'label', 'dorm', 'measure', ''), 'CFT100', named_struct('value', string(surface_total), 'label', 'tot', 'measure', 'm2'), '1000019', named_struct('value', case when id % 2 = 0 then 'Frente' end, 'label', 'disp', 'measure', ''), '1000029', named_struct('value', 'Norte', 'label', 'ori', 'measure', ''), 'X9', named_struct('value', case when id % 2 = 0 then 'si' end, 'label', 'Pileta', 'measure', '')),
  'postingLocation', named_struct('address', named_struct('name', address), 'postingGeolocation', named_struct('geolocation', named_struct('latitude', double(lat), 'longitude', double(lon))),
     'location', named_struct('depth', 3, 'name', neighborhood, 'parent', named_struct('depth', 2, 'name', city, 'parent', named_struct('depth', 1, 'name', province_name)))),
  'publisher', named_struct('publisherId', seller_id, 'name', seller_name, 'publisherTypeId', string(id % 4)), 'reserved', id % 3 = 0, 'postingCode', case when id % 6 = 0 then concat('code', external_id) else '' end))"""


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(view(spark, sf_dir, "listings"), "id").select("id", F.expr(_POSTING).alias("posting"))


_KEPT = "id % 100 <> 0 AND id % 40 NOT IN (33, 34)"
_L = ctes("listings")
_add("posting_normalize", lambda s, d: postings.normalize(raw_postings(s, d)).drop("extra_data"), _L + f"""SELECT external_id,
    CASE id % 3 WHEN 0 THEN 'https://portal.example/p-' || external_id || '.html' WHEN 1 THEN 'https://other.example/' || external_id ELSE 'https://portal.example/propiedades/' || external_id || '.html' END AS canonical_url,
    status, CAST('1999-05-0' || (id % 9 + 1) || ' 14:00:00' AS TIMESTAMP) AS source_modified_at, operation_type, property_type, title AS generated_title, CAST(NULL AS VARCHAR) AS description, 'm2' AS surface_unit, CASE WHEN id % 2 = 0 THEN 'Frente' END AS disposition, 'Norte' AS orientation, price_amount, price_currency,
    CASE WHEN id % 4 = 1 THEN expenses_amount END AS expenses_amount, CASE WHEN id % 4 = 1 THEN 'ARS' END AS expenses_currency, surface_total, CAST(NULL AS DECIMAL(18,2)) AS surface_covered, rooms, bedrooms,
    CAST(NULL AS INT) AS bathrooms, CAST(NULL AS INT) AS toilettes, CAST(NULL AS INT) AS antiquity_years, CAST(NULL AS INT) AS garages, address, province_name, city, neighborhood, lat, lon, seller_id, seller_name,
    CASE id % 4 WHEN 1 THEN 'particular' WHEN 2 THEN 'inmobiliaria' WHEN 3 THEN 'developer' END AS seller_type FROM listings WHERE {_KEPT}""")  # fmt: skip
_add("canonical_url", lambda s, d: postings.normalize(raw_postings(s, d)).select("external_id", "canonical_url"), _L + f"SELECT external_id, CASE id % 3 WHEN 0 THEN 'https://portal.example/p-' || external_id || '.html' WHEN 1 THEN 'https://other.example/' || external_id ELSE 'https://portal.example/propiedades/' || external_id || '.html' END AS canonical_url FROM listings WHERE {_KEPT}")
_add("feature_pivot", lambda s, d: postings.normalize(raw_postings(s, d)).select("external_id", "rooms", "bedrooms", "surface_total"), _L + f"SELECT external_id, rooms, bedrooms, surface_total FROM listings WHERE {_KEPT}")
_add("location_hierarchy", lambda s, d: postings.normalize(raw_postings(s, d)).select("external_id", "province_name", "city", "neighborhood"), _L + f"SELECT external_id, province_name, city, neighborhood FROM listings WHERE {_KEPT}")
_add("enum_map", lambda s, d: postings.normalize(raw_postings(s, d)).groupBy("status", "seller_type").agg(F.count(F.lit(1)).alias("n")), _L + f"SELECT status, CASE id % 4 WHEN 1 THEN 'particular' WHEN 2 THEN 'inmobiliaria' WHEN 3 THEN 'developer' END AS seller_type, count(*) AS n FROM listings WHERE {_KEPT} GROUP BY ALL")
_add("offset_timestamp", lambda s, d: view(s, d, "listings").select("id", postings.offset_time(F.expr("concat('1999-05-0', id % 9 + 1, case id % 3 when 0 then 'T10:00:00-0400' when 1 then 'T10:00:00.250-0400' else ' never' end)")).alias("at")), _L + "SELECT id, CASE id % 3 WHEN 0 THEN CAST('1999-05-0' || (id % 9 + 1) || ' 14:00:00' AS TIMESTAMP) WHEN 1 THEN CAST('1999-05-0' || (id % 9 + 1) || ' 14:00:00.25' AS TIMESTAMP) END AS at FROM listings")
_add("extra_data_pack", lambda s, d: postings.normalize(raw_postings(s, d)).select("external_id", F.get_json_object("extra_data", "$.posting_code").alias("posting_code"), F.get_json_object(F.get_json_object("extra_data", "$.feature_X9"), "$.value").alias("x9"), *[F.get_json_object("extra_data", f"$.{k}").alias(k) for k in ("reserved", "real_estate_type_id", "low_price_percentage")]),
     _L + f"SELECT external_id, CASE WHEN id % 6 = 0 THEN 'code' || external_id END AS posting_code, CASE WHEN id % 2 = 0 THEN 'si' END AS x9, CAST(id % 3 = 0 AS VARCHAR) AS reserved, CAST(id % 40 AS VARCHAR) AS real_estate_type_id, CASE WHEN id % 5 = 0 THEN '7.5' END AS low_price_percentage FROM listings WHERE {_KEPT}")


def _posting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of up to ten postings, under changing keys, with a total in changing form."""
    rows = view(spark, sf_dir, "listings").select(F.expr("id div 10").alias("page"), F.expr("named_struct('postingId', external_id)").alias("p"))
    bodies = rows.groupBy("page").agg(F.sort_array(F.collect_list("p")).alias("l"), F.count(F.lit(1)).alias("n"))
    return bodies.select("page", F.expr("case page % 3 when 0 then to_json(named_struct('listPostings', l, 'totalPosting', concat('1.', lpad(n, 3, '0')))) when 1 then to_json(named_struct('listPostings', filter(l, x -> false), 'items', l, 'paging', named_struct('total', n))) else to_json(named_struct('data', l, 'count', n)) end").alias("body"))


_add("posting_unnest", lambda s, d: postings.postings_of_page(_posting_pages(s, d)).select("page", F.get_json_object("posting", "$.postingId").alias("external_id")), _L + "SELECT id // 10 AS page, external_id FROM listings")
_add("total_count_extract", lambda s, d: _posting_pages(s, d).select("page", postings.total_count().alias("total")), _L + "SELECT page, CAST(CASE page % 3 WHEN 0 THEN 1000 + n ELSE n END AS INT) AS total FROM (SELECT id // 10 AS page, count(*) AS n FROM listings GROUP BY 1)")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "listings").select(F.expr("case when id % 10 = 0 then '  ' when id % 10 = 1 then concat('{\"external_id\": ', id) else to_json(named_struct('external_id', external_id, 'city', city)) end").alias("value"))


_add("jsonl_scan", lambda s, d: jsonl.parse_lines(_lines(s, d), "external_id STRING, city STRING"), _L + "SELECT external_id, city FROM listings WHERE id % 10 > 1")

_PARTS = "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_retailprice AS price FROM part"
_parts = lambda s, d: table(s, d, "part").selectExpr("p_partkey as id", "p_name as name", "p_brand as brand", "p_retailprice as price")
_add("slugify", lambda s, d: table(s, d, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug")), "SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
_add("ar_number", lambda s, d: _parts(s, d).select("id", X.ar_number(F.expr("concat('USD 1.', lpad(string(id % 1000), 3, '0'), ',', id % 10)")).alias("value")), f"SELECT id, CAST(1000 + id % 1000 AS DOUBLE) + (id % 10) / 10.0e0 AS value FROM ({_PARTS})")
_URL = "case id % 4 when 0 then concat('/propiedades/clasificado/casa-', id + 100000, '.html') when 1 then concat('https://p.example/propiedades/clasificado/x-', id + 100000, '.html?x=1#a') when 2 then concat('mailto:', id) else concat('https://p.example/propiedades/emprendimiento/y-', id, '.html') end"
_SURL = "CASE id % 4 WHEN 0 THEN '/propiedades/clasificado/casa-' || (id + 100000) || '.html' WHEN 1 THEN 'https://p.example/propiedades/clasificado/x-' || (id + 100000) || '.html?x=1#a' WHEN 2 THEN 'mailto:' || id ELSE 'https://p.example/propiedades/emprendimiento/y-' || id || '.html' END"
_add("external_id_from_url", lambda s, d: _parts(s, d).select("id", X.external_id(F.expr(_URL)).alias("external_id")), f"SELECT id, nullif(regexp_extract({_SURL}, '-(\\d{{6,}})\\.html$', 1), '') AS external_id FROM ({_PARTS})")
_add("listing_url_filter", lambda s, d: _parts(s, d).select("id", X.absolute_url(F.expr(_URL), "https://p.example/").alias("url")).where(X.is_listing_url(F.col("url"))), f"SELECT id, CASE WHEN id % 4 = 0 THEN 'https://p.example' ELSE '' END || regexp_replace({_SURL}, '[?#].*$', '') AS url FROM ({_PARTS}) WHERE id % 4 IN (0, 1) OR (id % 4 = 3 AND id >= 100000)")
_add("page_url_build", lambda s, d: _parts(s, d).select("id", X.page_url(F.expr("concat('https://p.example/casas', case when id % 2 = 0 then '-pagina-7' else '' end, '.html')"), F.col("id") % 5).alias("url")), f"SELECT id, 'https://p.example/casas' || CASE WHEN id % 5 <= 1 THEN CASE WHEN id % 2 = 0 THEN '-pagina-7' ELSE '' END ELSE '-pagina-' || (id % 5) END || '.html' AS url FROM ({_PARTS})")
_add("coord_normalize", lambda s, d: _parts(s, d).select("id", X.coordinate(F.expr("case id % 3 when 0 then -34.6D - id / 1000.0D when 1 then -346000000.0D - id else 99999999999.0D end"), 90).alias("lat")), f"SELECT id, CASE id % 3 WHEN 0 THEN CASE WHEN abs(-34.6e0 - id / 1000.0e0) <= 90 THEN round(-34.6e0 - id / 1000.0e0, 7) ELSE round((-34.6e0 - id / 1000.0e0) / 1e7, 7) END WHEN 1 THEN round((-346000000.0e0 - id) / 1e7, 7) END AS lat FROM ({_PARTS})")
_add("address_dedupe", lambda s, d: _parts(s, d).select("id", X.dedupe_parts(F.expr("concat(case when id % 2 = 0 then 'Ubicación ' else 'UBICACION ' end, brand, ', , ', name, ', ', brand, ' ,Rosario', case when id % 3 = 0 then ' VER INFORMACION, de x' else '' end, ',')")).alias("address")), f"SELECT id, CASE WHEN brand = name THEN brand || ', Rosario' ELSE brand || ', ' || name || ', Rosario' END AS address FROM ({_PARTS})")

# Landed pages.
_add("page_links", lambda s, d: pages.links(table(s, d, "pages"), "https://site.example").select("page_id", "position", "url"), """
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS INT) AS position, 'https://site.example' || u AS url
    FROM (SELECT page_id, regexp_replace(h, '[?#].*$', '') AS u, min(p) AS p FROM (SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) AS p
      FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS l FROM pages)) WHERE h LIKE '/%' GROUP BY ALL)""")  # fmt: skip
_add("page_titles", lambda s, d: pages.titles(table(s, d, "pages")), """
    SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), '') AS h1 FROM pages""")  # fmt: skip

_HOSTS = [
    ("zonaprop", "https://www.zonaprop.com.ar/"), ("argenprop", "https://www.argenprop.com/"), ("mercadolibre", "https://casa.mercadolibre.com.ar/MLA-1"), ("mercadolibre", "https://mercadolibre.com/MLA-2"), (None, "https://mercadolibre.com/x"),
    ("lacapital", "https://inmuebles.lacapital.com.ar/"), ("propia", "https://propia.com.ar/"), ("liderprop", "https://liderprop.com/"), ("inmoclick", "https://inmoclick.com/"), ("buscadorprop", "https://www.buscadorprop.com.ar/"),
    ("buscainmueble", "https://www.buscainmueble.com/"), ("clarin", "https://www.inmuebles.clarin.com/"), ("doomos", "https://ar.doomos.com/"), (None, "https://portal.example/"),
]
_HOST_LIST = ", ".join(f"'{u}'" for _, u in _HOSTS)
_NAME_LIST = ", ".join(f"'{n}'" if n else "NULL" for n, _ in _HOSTS)


def hosted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages under addresses of the portals, with links of the portals' forms in both kinds of quotes."""
    made = """concat('<p>', html, '</p><a class="x" href=\\'/propiedad/', page_id, '-a?x=1\\'>a</a><a href="/propiedad/', page_id, '-a#b">b</a><a href="/casa-en-venta-', page_id, '">c</a>
      <a href="https://depto.mercadolibre.com.ar/MLA-', page_id, '-x?q=1">d</a><a href="/inmuebles/', page_id, '/ficha/z">e</a><a href="/es-ar/propiedades/venta/r', page_id, '">f</a><a href="/propiedades/x-', page_id, '">g</a>
      <a href="/inmuebles/casa/venta/mitre-10_', page_id, '">h</a><a href="/ayuda">i</a>')"""
    return table(spark, sf_dir, "pages").select("page_id", F.expr(f"concat(array({_HOST_LIST})[page_id % {len(_HOSTS)}], 'p')").alias("url"), F.expr(made).alias("html"))


_add("portal_route", lambda s, d: hosted_pages(s, d).select("page_id", pages.route(F.col("url")).alias("portal")), f"SELECT page_id, [{_NAME_LIST}][page_id % {len(_HOSTS)} + 1] AS portal FROM pages")
_add("portal_links", lambda s, d: pages.portal_links(hosted_pages(s, d)).select("page_id", "portal", "position", "link"), f"""
    WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS i, [{_NAME_LIST}][page_id % {len(_HOSTS)} + 1] AS portal FROM pages)
    SELECT page_id, portal, CAST(0 AS INT) AS position, CASE portal WHEN 'argenprop' THEN 'https://www.argenprop.com/casa-en-venta-' || i WHEN 'mercadolibre' THEN 'https://depto.mercadolibre.com.ar/MLA-' || i || '-x'
      WHEN 'lacapital' THEN 'https://inmuebles.lacapital.com.ar/inmuebles/casa/venta/mitre-10_' || i WHEN 'propia' THEN 'https://propia.com.ar/casa-en-venta-' || i WHEN 'liderprop' THEN 'https://liderprop.com/es-ar/propiedades/venta/r' || i
      WHEN 'inmoclick' THEN 'https://inmoclick.com/inmuebles/' || i || '/ficha/z' WHEN 'buscadorprop' THEN 'https://www.buscadorprop.com.ar/propiedad/' || i || '-a' WHEN 'buscainmueble' THEN 'https://www.buscainmueble.com/propiedad/' || i || '-a'
      WHEN 'clarin' THEN 'https://www.inmuebles.clarin.com/propiedades/x-' || i WHEN 'doomos' THEN 'https://ar.doomos.com/propiedad/' || i || '-a' END AS link
    FROM p WHERE portal IS NOT NULL AND portal <> 'zonaprop'""")  # fmt: skip

# Parts of a listing page over the stand-in listings: nested elements, quotes of both kinds, and sources that disagree.
_HEAD = r"""concat('<html><head><title>', title, '</title>', case id % 5 when 4 then '' when 3 then concat('<meta content=\'https://img.example/', id, '.jpg\' property=\'og:image\'/>') else concat('<meta property="og:image" content="https://img.example/', id, '.jpg">') end,
  case when id % 4 <> 3 then concat('<script type="application/ld+json">', to_json(named_struct('@type', 'House', 'name', concat('LD ', title, ' - Portal'), 'description', case when id % 4 < 2 then 'LD text' end, 'numberOfBedrooms', case when id % 3 = 0 then bedrooms end,
    'address', named_struct('streetAddress', address, 'addressRegion', province_name, 'addressLocality', concat(city, ', ', province_name, ', Argentina, ')), 'geo', case when id % 6 = 0 then named_struct('latitude', -30.5D, 'longitude', -60.25D) end,
    'offers', case when price_currency = 'USD' then named_struct('price', string(price_amount), 'priceCurrency', 'USD') end, 'floorSize', named_struct('value', string(surface_total)))), '</script>') else '' end)"""
_SCRIPT = r"""concat('<script>', case when id % 4 <> 3 then concat('const antiquity = \'Publicado ', case id % 4 when 0 then concat('hace ', id % 20 + 2, ' días') when 1 then 'hoy' else concat('hace ', id % 5 + 2, ' meses') end, '\';') else '' end, ' const usersViews = ', id * 3, ';
  var state = { postingType = "PROPERTY", postingStatus = "ONLINE" }; publisher = {"publisherId": ', id % 4, ', "license": "L }', id, '", "urlLogo": ""}; var t = {tier: "', id % 5, '"}; names = {\'1\': \'simple\', \'2\': \'destacado\'};
  map = {"visibility": "exact"', case when id % 2 = 0 then ', "videoUrl": "https://v.example/1"' else '' end, '}; const videos = []; tour360Url = "', case when id % 3 = 0 then 'https://t.example' else '' end, '";',
  case when lat is not null then concat(' latitude: ', bigint(lat * 10000000), ',') else '' end, case when lon is not null then concat(' longitude = \'', lon, '\';') else '' end,
  ' const generalFeatures = {"Exterior":{"1":{"label":"Parrilla","value":null},"2":{"label":"Cantidad plantas","value":"', id % 5, '"},"3":{"label":"Baños","icon":"bano","value":"2"},"4":{"label":"Nota","value":"a};b","measure":"m"}},"Interior":{"9":{"label":"Nota","value":"z"}}}; var tail = {};</script>')"""
_DATA = r"""concat('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"listing":{"geo":{"lat":-1.5},"location":{"lat":-34.25,"lon":-58.5},"price":{"amount":', price_amount + 2, case when price_currency is not null then concat(',"currency":"', price_currency, '"') else '' end, '}}}}',
  case when id % 2 = 0 then concat(',"link":"https:\\/\\/portal.example\\/propiedades\\/clasificado\\/otra-', id + 200000, '.html"') else '' end, '}</script>')"""
_PLACE = r"""concat('</head><body><h1 class="t">', title, ' <span>1</span></h1>', case when id % 6 <> 5 then concat('<section><div class="x price-value"><div>', coalesce(operation_type, 'Consultar'), '</div> <span><b>', case when price_currency = 'USD' then 'USD' when price_currency = 'ARS' then 'ARS' else '$' end, '</b>
   ', regexp_replace(format_number(bigint(price_amount), 0), ',', '.'), '</span></div></section>') else '' end, '<h2 class="title-type-sup-property"><em>', case id % 3 when 0 then 'Casa' when 1 then 'Oficina' else 'PH' end, '</em> · ', rooms, ' ambientes</h2>',
  '<div data-qa="posting-description"><div>Bright   home<br>', address, '</div></div>', case when id % 4 = 3 then concat('<div><p>Publicado hace ', id % 5 + 2, ' días</p></div><p data-qa="posting-location"> Calle <b>', id, '</b></p>') else '' end)"""
_ICONS = r"""concat('<ul><li>', rooms, ' amb. <i class="big icon-ambiente"></i></li><li><i class="icon-bano"></i> <span>', bathrooms, ' baños</span></li><li><i class="icon-antiguedad"></i> ', case when id % 3 = 0 then 'A estrenar' else concat(id % 30, ' años') end, '</li></ul>',
  '<div><b><i class="icon-cochera"></i>', garages, '</b></div>', case when surface_total is not null then concat('<li><i class=\'icon-stotal\'></i>', surface_total, ' m²</li>') else '' end)"""
_SELLER = r"""case when seller_name is null then '' when id % 4 = 1 then concat('<a data-qa=\'linkMicrositioAnuncianteLeads\' href=\'/constructoras/x\'> <b>', seller_name, '</b></a>') when id % 4 = 2 then concat('<a data-qa="publisher" href="/inmobiliarias/y">', seller_name, '</a>')
  when id % 8 = 3 then concat('<div class="publisherCard-module"><p class="badge">Usuario <b>Particular</b></p><a class="publisherCard-module__info-name___x" href="/u">', seller_name, '</a></div>') else concat('<span class="publisher-name"> ', seller_name, '</span>') end"""
_REST = r"""concat(case when id % 10 = 4 then concat('<div class="main-gallery"><img alt="x" data-src="https://img.example/g/', id, '.jpg"></div>') else '' end,
  array_join(transform(filter(sequence(0, 5), x -> x < id % 6), x -> concat('<img src="/avisos/1/', regexp_replace(lpad(string(id + 100000), 8, '0'), '(..)', '$1/'), '360x266/', 7000 + x, '.jpg"><img src="/avisos/1/', regexp_replace(lpad(string(id + 100000), 8, '0'), '(..)', '$1/'), '720x532/', 7000 + x, '.jpg">')), ''),
  '<a href="/propiedades/clasificado/tercera-', id + 300000, '.html">next</a><a href="/ayuda">help</a></body></html>')"""
# Pages of portals with other layouts: none of its own, a hidden input, rendered by scripts, pictures in spans.
_PLAIN = r"""concat('<html><head>', case when id % 4 <> 3 then concat('<script type="application/ld+json">', to_json(named_struct('@type', 'House', 'address', named_struct('streetAddress', address, 'addressRegion', province_name),
    'offers', case when price_currency = 'USD' then named_struct('price', string(price_amount), 'priceCurrency', 'USD') end, 'floorSize', named_struct('value', string(surface_total)))), '</script>') else '' end,
  '</head><body><p>Precio <b>U$S</b> ', string(bigint(price_amount)), ' cubierta ', surface_covered, ' m² <i>cubiertos</i>, 3 m2 semicubiertos', case when id % 2 = 0 then ' con cochera' else ' y piscina' end, ' antigüedad: ', id % 30 + 1, ' años, orientación: ', case when id % 2 = 0 then 'NE' else 'Sur' end, ', piso ', id % 9, '</p></body></html>')"""
_HIDDEN = r"""concat('<html><head>', case when id % 4 = 0 then concat('<script type="application/ld+json">{"@type":"House","address":{"streetAddress":"', address, '"},"floorSize":{"value":"9"},"datePosted":"1999-05-0', id % 9 + 1, '"}</script>') else '' end,
  case when id % 2 = 0 then '<script type="application/ld+json">{"@type":"VideoObject","uploadDate":"1999-04-01"}</script>' else '' end, '</head><body>', case when id % 3 <> 2 then concat('<input type=hidden data-price=\'', price_amount, '\' data-moneda="', coalesce(price_currency, ''), '" data-tipo-propiedad="',
    case id % 3 when 0 then 'Oficina' else 'otro' end, '" data-barrio="', coalesce(neighborhood, ''), '" data-localidad="', city, '">') else concat('<p class="card-price"><span>$</span> ', regexp_replace(format_number(bigint(price_amount * 100), 0), ',', '.'), '</p>') end,
  '<div class="property-features"><p>', case when surface_total is not null then concat('Sup. <b>Total</b>: ', surface_total, ' ') else '' end, '</p></div><ul class="x property-features"><li>Sup. Cubierta: ', surface_covered, '</li><li>Antigüedad: ', id % 30, '</li><li>Orientación: ', case when id % 2 = 0 then 'Noroeste' else 'S' end, '</li><li>Piso 3</li>',
  case when id % 5 = 0 then '<li>Cochera</li>' else '<li>Pileta</li>' end, '</ul></body></html>')"""
_SHOWN = r"""concat('<html><body>', case when id % 3 = 0 then concat('<script type="application/ld+json">{"@type":"Product","offers":{"price":', price_amount, '},"address":{"streetAddress":"', address, ', ', city, '","addressRegion":"', city, '"},"datePublished":"1999-05-01"}</script>') else '' end,
  '<span class="andes-money-amount"><span>U$S</span> <span>', regexp_replace(format_number(bigint(price_amount), 0), ',', '.'), '</span></span><div class="ui-location"><p>UBICACION ', address, ', , ', city, ', ', city, ' Ver información de la zona</p></div>',
  '<p>', case id % 3 when 0 then 'PH' when 1 then 'Oficina' else 'Local comercial' end, ' de ', surface_covered, ' m² <b>totales</b>, ', id % 30, ' años de antigüedad, piso ', id % 9, case when id % 2 = 0 then ', cochera' else '' end, '</p></body></html>')"""
_SPANS = r"""concat('<p class="miniinfo"><span><img src="/img/ico_precio_us.png"> <b>', string(bigint(price_amount)), '</b></span><span><b><img src=\'/img/ico_mt2cub.png\'></b>', surface_covered, '</span><span><img src="/img/ico_cocheras.png">', case when id % 7 = 0 then '--' else string(garages) end, '</span><span><img src="/img/ico_banios.png"> ', bathrooms, '</span></p>',
  '<script>geo_propiedades = [{ubicacion: \'', address, '\'}];</script>')"""


def _made(*parts: str):
    """Pages put together from parts over the listings."""
    body = f"concat({', '.join(parts)})"
    return lambda s, d: spread(view(s, d, "listings"), "id").select("id", F.expr(body).alias("html"), F.expr("concat('https://portal.example/propiedades/clasificado/casa-', id + 100000, '.html')").alias("url"))


made_pages = _made(_HEAD, _SCRIPT, _DATA, _PLACE, _ICONS, _SELLER, _REST)
_plain, _hidden, _shown, _spans = (_made(x) for x in (_PLAIN, _HIDDEN, _SHOWN, _SPANS))
_DAYS = "CAST(CASE id % 4 WHEN 0 THEN id % 20 + 2 WHEN 1 THEN 0 WHEN 2 THEN (id % 5 + 2) * 30 END AS INT)"
_KIND = "CASE id % 3 WHEN 0 THEN 'Casa' WHEN 1 THEN 'Oficina' ELSE 'PH' END"
_WHOLE = "CAST(floor(price_amount) AS BIGINT)"
_OFFER = "CASE WHEN id % 4 <> 3 AND price_currency = 'USD' THEN"
_IMAGE = "CASE WHEN id % 5 <> 4 THEN 'https://img.example/' || id || '.jpg' WHEN id % 10 = 4 THEN 'https://img.example/g/' || id || '.jpg' END"
_SELLER_TYPE = "CASE WHEN seller_name IS NULL THEN NULL WHEN id % 4 = 1 THEN 'desarrollador' WHEN id % 4 = 2 THEN 'inmobiliaria' WHEN id % 8 = 3 THEN 'particular' END"
_SIGN = "CASE WHEN price_currency = 'USD' THEN 'USD' ELSE 'ARS' END"
_TIER = "CASE id % 5 WHEN 1 THEN 'simple' WHEN 2 THEN 'destacado' WHEN 3 THEN 'superdestacado' WHEN 4 THEN 'free' END"

_add("page_ldjson", lambda s, d: pages.ld_json(made_pages(s, d)).select("id", "address", "price", "currency", "surface", "kind"), _L + f"""
    SELECT id, CASE WHEN id % 4 <> 3 THEN concat_ws(', ', address, province_name) END AS address, {_OFFER} {_WHOLE} END AS price, {_OFFER} 'USD' END AS currency,
      CASE WHEN id % 4 <> 3 THEN CAST(surface_total AS DOUBLE) END AS surface, CASE WHEN id % 4 <> 3 THEN 'Casa' END AS kind FROM listings""")  # fmt: skip
_add("page_body_text", lambda s, d: pages.body_text(_plain(s, d)).drop("html", "url"), _L + f"""
    SELECT id, CASE WHEN price_amount > 1000 THEN {_WHOLE} END AS body_price, CAST(surface_covered AS DOUBLE) AS body_surface, 3.0e0 AS body_semi, id % 2 = 0 AS body_garage, id % 2 = 1 AS body_pool, CAST(id % 30 + 1 AS INT) AS body_age,
      CASE WHEN id % 2 = 0 THEN 'Norte' ELSE 'Sur' END AS body_orientation, CAST(id % 9 AS INT) AS body_floor FROM listings""")  # fmt: skip
_add("page_og_image", lambda s, d: made_pages(s, d).select("id", pages.og_image(F.col("html")).alias("image")), _L + "SELECT id, CASE WHEN id % 5 <> 4 THEN 'https://img.example/' || id || '.jpg' END AS image FROM listings")
_add("page_inline_vars", lambda s, d: pages.inline_variables(made_pages(s, d)).drop("html", "url", "published_text"), _L + f"""
    SELECT id, {_DAYS} AS days, CAST(id * 3 AS INT) AS views, 'PROPERTY' AS posting_type, 'ONLINE' AS posting_status, {_TIER} AS publication_tier, nullif(CAST(id % 4 AS VARCHAR), '0') AS seller_id, 'L }}' || id AS seller_license,
      CAST(NULL AS VARCHAR) AS seller_logo, 'EXACT' AS visibility, id % 2 = 0 AS has_video, id % 3 = 0 AS has_tour_360, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM listings""")  # fmt: skip
_add("page_price_block", lambda s, d: pages.price_block(made_pages(s, d)).select("id", "operation", "block_currency", "block_amount"), _L + f"""
    SELECT id, CASE WHEN id % 6 <> 5 THEN operation_type END AS operation, CASE WHEN id % 6 <> 5 THEN {_SIGN} END AS block_currency, CASE WHEN id % 6 <> 5 THEN {_WHOLE} END AS block_amount FROM listings""")  # fmt: skip
_add("page_icon_features", lambda s, d: pages.icon_features(made_pages(s, d)).drop("html", "url"), _L + """
    SELECT id, CAST(rooms AS INT) AS icon_rooms, CAST(bathrooms AS INT) AS icon_bathrooms, CAST(garages AS INT) AS icon_garages, CAST(NULL AS INT) AS icon_bedrooms, CAST(NULL AS INT) AS icon_toilettes, CAST(NULL AS INT) AS icon_floor,
      CAST(surface_total * 100 AS DOUBLE) AS icon_total, CAST(NULL AS DOUBLE) AS icon_covered, CAST(NULL AS DOUBLE) AS icon_semi, CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE id % 30 END AS INT) AS icon_age, CAST(NULL AS VARCHAR) AS icon_orientation FROM listings""")  # fmt: skip
_add("page_features", lambda s, d: pages.features(made_pages(s, d)).select("id", "key", "value"), _L + """
    SELECT id, 'parrilla' AS key, 'true' AS value FROM listings UNION ALL SELECT id, 'cantidad_plantas', CAST(id % 5 AS VARCHAR) FROM listings WHERE id % 5 <> 0 UNION ALL SELECT id, 'nota', 'z' FROM listings""")  # fmt: skip
_add("page_picture_count", lambda s, d: made_pages(s, d).select("id", pages.picture_count(F.col("html"), F.col("id") + 100000).alias("pictures")), _L + "SELECT id, CAST(CASE WHEN id % 6 > 0 THEN id % 6 END AS INT) AS pictures FROM listings")
_add("page_text_fields", lambda s, d: pages.text_fields(made_pages(s, d)).drop("html", "url"), _L + f"""
    SELECT id, {_KIND} AS type, 'Bright home' || chr(10) || address AS description, title || ' 1' AS heading, CAST(CASE WHEN id % 4 = 3 THEN id % 5 + 2 END AS INT) AS page_days FROM listings""")  # fmt: skip
_add("page_seller", lambda s, d: pages.seller(made_pages(s, d)).select("id", "seller_name", "seller_type"), _L + f"SELECT id, seller_name, {_SELLER_TYPE} AS seller_type FROM listings")
_add("page_ldjson_property", lambda s, d: pages.ld_property(made_pages(s, d)).drop("html", "url"), _L + """
    SELECT id, CASE WHEN id % 4 <> 3 THEN 'LD ' || title END AS ld_title, CASE WHEN id % 4 < 2 THEN 'LD text' END AS ld_description, CAST(CASE WHEN id % 4 <> 3 AND id % 3 = 0 THEN bedrooms END AS INT) AS ld_bedrooms, CAST(NULL AS INT) AS ld_bathrooms,
      CASE WHEN id % 4 <> 3 THEN address END AS ld_street, CASE WHEN id % 4 <> 3 THEN province_name END AS ld_neighborhood, CASE WHEN id % 4 <> 3 THEN city END AS ld_city, CASE WHEN id % 4 <> 3 THEN province_name END AS ld_province,
      CASE WHEN id % 4 <> 3 THEN 'Argentina' END AS ld_country, CASE WHEN id % 4 <> 3 AND id % 6 = 0 THEN -30.5e0 END AS ld_lat, CASE WHEN id % 4 <> 3 AND id % 6 = 0 THEN -60.25e0 END AS ld_lon FROM listings""")  # fmt: skip
_add("page_next_data", lambda s, d: pages.next_data(made_pages(s, d)).drop("html", "url"), _L + f"SELECT id, {_WHOLE} + 2 AS next_price, coalesce(price_currency, 'USD') AS next_currency, -34.25e0 AS next_lat, -58.5e0 AS next_lon FROM listings")
_add("next_data_links", lambda s, d: pages.next_data_links(made_pages(s, d)).select("id", "link"), _L + "SELECT id, 'https://portal.example/propiedades/clasificado/otra-' || (id + 200000) || '.html' AS link FROM listings WHERE id % 2 = 0")
_add("listing_page_links", lambda s, d: pages.listing_links(made_pages(s, d), "https://portal.example").select("id", "external_id", "link"), _L + """
    SELECT id, CAST(id + 200000 AS VARCHAR) AS external_id, 'https://portal.example/propiedades/clasificado/otra-' || (id + 200000) || '.html' AS link FROM listings WHERE id % 2 = 0
    UNION ALL SELECT id, CAST(id + 300000 AS VARCHAR), 'https://portal.example/propiedades/clasificado/tercera-' || (id + 300000) || '.html' FROM listings WHERE id % 2 = 1""")  # fmt: skip
_add("page_extract_priority", lambda s, d: pages.assemble(made_pages(s, d)).drop("url", "published_text"), _L + f"""
    SELECT id, CAST(id + 100000 AS VARCHAR) AS external_id, title || ' 1' AS title, CASE WHEN id % 4 < 2 THEN 'LD text' ELSE 'Bright home' || chr(10) || address END AS description, CASE WHEN id % 6 <> 5 THEN operation_type END AS operation,
      coalesce({_DAYS}, CAST(id % 5 + 2 AS INT)) AS days, CAST(id * 3 AS INT) AS views, 'PROPERTY' AS posting_type, 'ONLINE' AS posting_status, {_TIER} AS publication_tier,
      CASE WHEN id % 6 <> 5 THEN {_WHOLE} ELSE {_WHOLE} + 2 END AS price, CASE WHEN id % 6 <> 5 THEN {_SIGN} ELSE coalesce(price_currency, 'USD') END AS price_currency, {_KIND} AS type, CAST(rooms AS INT) AS rooms,
      CAST(CASE WHEN id % 4 <> 3 AND id % 3 = 0 THEN nullif(bedrooms, 0) END AS INT) AS bedrooms, CAST(bathrooms AS INT) AS bathrooms, CAST(NULL AS INT) AS toilettes, CAST(surface_total * 100 AS DOUBLE) AS surface_total, CAST(NULL AS DOUBLE) AS surface_covered,
      CAST(NULL AS DOUBLE) AS surface_semi, CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE id % 30 END AS INT) AS age, CAST(NULL AS VARCHAR) AS orientation, CAST(NULL AS INT) AS floor, CASE WHEN garages > 0 THEN true END AS garage,
      CASE WHEN id % 4 <> 3 THEN address ELSE 'Calle ' || id END AS address, CASE WHEN id % 4 <> 3 THEN 'Argentina' END AS country, CASE WHEN id % 4 <> 3 THEN province_name END AS province, CASE WHEN id % 4 <> 3 THEN city END AS city,
      CASE WHEN id % 4 <> 3 THEN province_name END AS neighborhood, coalesce(CASE WHEN id % 4 <> 3 AND id % 6 = 0 THEN -30.5e0 END, CAST(lat AS DOUBLE), -34.25e0) AS lat, coalesce(CASE WHEN id % 4 <> 3 AND id % 6 = 0 THEN -60.25e0 END, CAST(lon AS DOUBLE), -58.5e0) AS lon,
      'EXACT' AS address_visibility, {_IMAGE} AS image, CAST(CASE WHEN id % 6 > 0 THEN id % 6 END AS INT) AS pictures, id % 2 = 0 AS has_video, id % 3 = 0 AS has_tour_360, seller_name, {_SELLER_TYPE} AS seller_type,
      nullif(CAST(id % 4 AS VARCHAR), '0') AS seller_id, 'L }}' || id AS seller_license, CAST(NULL AS VARCHAR) AS seller_logo, CAST(2 AS INT) AS feature_sections FROM listings""")  # fmt: skip
_add("page_extract_generic", lambda s, d: pages.generic(_plain(s, d)).select("id", "price", "surface", "layout"), _L + f"""
    SELECT id, CASE WHEN id % 4 <> 3 THEN CASE WHEN price_currency = 'USD' THEN {_WHOLE} END WHEN price_amount > 1000 THEN {_WHOLE} END AS price, CASE WHEN id % 4 <> 3 THEN CAST(surface_total AS DOUBLE) ELSE CAST(surface_covered AS DOUBLE) END AS surface,
      CASE WHEN id % 4 <> 3 THEN 'json-ld' ELSE 'body' END AS layout FROM listings""")  # fmt: skip
_add("page_hidden_input", lambda s, d: pages.hidden_inputs(_hidden(s, d)).drop("html", "url", "image"), _L + f"""
    SELECT id, CASE WHEN id % 3 <> 2 THEN {_WHOLE} ELSE CAST(floor(price_amount * 100) AS BIGINT) END AS hidden_price, CASE WHEN id % 3 <> 2 THEN {_SIGN} ELSE 'ARS' END AS hidden_currency, CASE WHEN id % 4 = 0 THEN 'Casa' WHEN id % 3 = 0 THEN 'Local' END AS hidden_kind,
      CAST(surface_covered AS DOUBLE) AS covered, CAST(NULL AS DOUBLE) AS semi, CASE WHEN surface_total > surface_covered THEN round(CAST(surface_total - surface_covered AS DOUBLE), 1) END AS uncovered, CAST(id % 30 AS INT) AS hidden_age,
      CASE WHEN id % 2 = 0 THEN 'Norte' ELSE 'Sur' END AS hidden_orientation, CAST(3 AS INT) AS hidden_floor, CASE WHEN id % 5 = 0 THEN true END AS hidden_garage, CASE WHEN id % 5 <> 0 THEN true END AS hidden_pool,
      CASE WHEN id % 4 = 0 THEN address WHEN id % 3 <> 2 AND neighborhood <> '' THEN neighborhood || ', ' || city END AS hidden_address, CASE WHEN id % 4 = 0 THEN '1999-05-0' || (id % 9 + 1) WHEN id % 2 = 0 THEN '1999-04-01' END AS hidden_posted FROM listings""")  # fmt: skip
_add("page_rendered", lambda s, d: pages.rendered(_shown(s, d)).drop("html", "url", "image"), _L + f"""
    SELECT id, CASE WHEN id % 3 = 0 OR floor(price_amount) > 1000 THEN {_WHOLE} END AS shown_price, address || ', ' || city AS shown_address, CASE WHEN id % 3 = 0 THEN '1999-05-01' END AS shown_posted, CAST(surface_covered AS DOUBLE) AS shown_covered,
      CAST(NULL AS DOUBLE) AS shown_semi, CASE id % 3 WHEN 0 THEN 'PH' ELSE 'Local' END AS shown_kind, CAST(id % 30 AS INT) AS shown_age, CAST(NULL AS VARCHAR) AS shown_orientation, CAST(id % 9 AS INT) AS shown_floor,
      CASE WHEN id % 2 = 0 THEN true END AS shown_garage, CAST(NULL AS BOOLEAN) AS shown_pool FROM listings""")  # fmt: skip
_add("page_icon_image", lambda s, d: pages.icon_images(_spans(s, d)).drop("html", "url"), _L + f"""
    SELECT id, CAST(bathrooms AS INT) AS image_bathrooms, CAST(CASE WHEN id % 7 = 0 THEN NULL ELSE garages END AS INT) AS image_garages, CASE WHEN floor(price_amount) > 100 THEN {_WHOLE} END AS image_price, CAST(surface_covered AS DOUBLE) AS image_covered, coalesce(id % 7 <> 0 AND garages > 0, false) AS image_garage, address AS image_address FROM listings""")  # fmt: skip
_add("page_main_image", lambda s, d: pages.media(made_pages(s, d)).select("id", "image"), _L + f"SELECT id, {_IMAGE} AS image FROM listings")
_add("page_address", lambda s, d: pages.address(made_pages(s, d)).select("id", "page_address"), _L + "SELECT id, CASE WHEN id % 4 = 3 THEN 'Calle ' || id END AS page_address FROM listings")
