"""DuckDB SQL of the queries that SQL can express. Each takes the plainest way, never the operator's own."""

from __future__ import annotations

from . import license_scan as L
from . import quality_rules as Q
from . import revisits as V


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def license_scan() -> str:
    """Every block of a document against every template of which the document has enough words."""
    known = L.templates(L.LicenseConfig())
    templates = ", ".join(f"('{t.label}', {_list(list(t.words))}, {t.need}, {t.block}, CAST({_list(list(t.required))} AS VARCHAR[]), CAST({_list(list(t.excluded))} AS VARCHAR[]))" for t in known)
    cuts = ", ".join(f"({b}, {s})" for b, s in sorted({(t.block, t.step) for t in known}))
    phrases = ", ".join(f"('{label}', {_list(p.split())}, {len(p.split())})" for p, label in L.PHRASES.items())
    return rf"""
    WITH templates(label, t, need, c, required, excluded) AS (VALUES {templates}), cuts(c, step) AS (VALUES {cuts}), phrases(label, p, m) AS (VALUES {phrases}),
    docs AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{L.UPPER}', '{L.LOWER}'), '{L.NOT_WORD}'), lambda w: w <> '') AS w FROM documents),
    places AS (SELECT rid, label, i FROM (SELECT rid, w, unnest(range(0, len(w))) AS i FROM docs), phrases WHERE w[i + 1] = p[1] AND w[i + 1:i + m] = p),
    base AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS b, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY rid),
    able AS (SELECT rid, w, tm.*, step FROM docs, templates tm JOIN cuts USING (c) WHERE len(list_intersect(t, w)) >= need),
    blocks AS (SELECT rid, label, t, need, required, excluded, w[s + 1:s + c] AS b FROM (SELECT *, unnest(range(0, greatest(CASE WHEN step = 1 THEN len(w) - c + 1 ELSE len(w) END, 1), step)) AS s FROM able)),
    hits AS (SELECT rid, label, len(list_intersect(t, b)) / CAST(len(t) AS DOUBLE) AS share FROM blocks WHERE len(list_intersect(t, b)) >= need AND len(list_intersect(required, b)) = len(required) AND len(list_intersect(excluded, b)) = 0),
    found AS (SELECT rid, list_distinct(list(label)) AS labels, max(share) AS share, count(*) AS n FROM hits GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
      CASE WHEN base.n > 0 THEN 1.0e0 ELSE coalesce(round(share, 6), 0.0e0) END AS score, coalesce(found.n, 0) AS n_blocks
    FROM docs LEFT JOIN base ON docs.rid = base.rid LEFT JOIN found ON docs.rid = found.rid"""


def quality_rules() -> str:
    c = Q.QualityConfig()
    classes = [r"\p{Ll}+", r"\s+", r"\p{Lu}+", "[0-9]+", r"\p{L}+"]
    steps, at = [], "x0"
    for i, p in enumerate(classes):
        # Java's white space has the vertical tab, RE2's has not
        steps.append(f"regexp_replace({at}, '{p if p != chr(92) + 's+' else '[' + chr(92) + 's' + chr(92) + 'x0B]+'}', '', 'g') AS x{i + 1}")
        at = f"x{i + 1}"
    nested = "SELECT *, coalesce(text, '') AS x0 FROM documents"
    for s in steps:
        nested = f"SELECT *, {s} FROM ({nested})"
    counts = "[" + ", ".join(f"length(x{i}) - length(x{i + 1})" for i in range(5)) + ", length(x5)]"
    part = "CASE WHEN p > 0 THEN p * log2(p * 2 / (p + q)) ELSE 0.0e0 END + CASE WHEN q > 0 THEN q * log2(q * 2 / (p + q)) ELSE 0.0e0 END"
    return rf"""
    WITH base AS (SELECT row_number() OVER () AS rid, doc_id, lang, x0 AS t, {counts} AS cls, list_filter(regexp_split_to_array(x0, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM ({nested})),
    each AS (SELECT rid, lang, len(w) AS n_words, unnest(w) AS word FROM base),
    totals AS (SELECT lang, count(*) AS total FROM each WHERE lang IS NOT NULL GROUP BY lang),
    top AS (SELECT lang, word, count(*) AS n FROM each WHERE lang IS NOT NULL GROUP BY lang, word QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) <= {c.common_words}),
    bins AS (SELECT lang, word, n / CAST(total AS DOUBLE) AS q FROM top JOIN totals USING (lang)
      UNION ALL SELECT lang, NULL, (total - sum(n)) / CAST(total AS DOUBLE) FROM top JOIN totals USING (lang) GROUP BY lang, total),
    uses AS (SELECT rid, word, count(*) AS n FROM each WHERE n_words >= {c.min_words_for_common} GROUP BY ALL),
    known AS (SELECT rid, lang, sum(uses.n) AS n FROM uses JOIN top USING (word) GROUP BY ALL),
    pairs AS (SELECT d.rid, b.lang, q, (CASE WHEN b.word IS NULL THEN len(w) - coalesce(k.n, 0) ELSE coalesce(u.n, 0) END) / CAST(len(w) AS DOUBLE) AS p FROM base d, bins b LEFT JOIN uses u ON u.rid = d.rid AND u.word = b.word LEFT JOIN known k ON k.rid = d.rid AND k.lang = b.lang WHERE len(w) >= {c.min_words_for_common}),
    near AS (SELECT rid, round(min(d), 6) AS common_distance FROM (SELECT rid, lang, sqrt(greatest(sum({part}) / 2, 0.0e0)) AS d FROM pairs GROUP BY ALL) GROUP BY rid),
    sums AS (SELECT lang, i, sum(cls[i]) AS n FROM base, range(1, 7) r(i) WHERE lang IN (SELECT lang FROM totals) GROUP BY ALL),
    kinds AS (SELECT lang, i, n / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE) AS q FROM sums),
    shapes AS (SELECT rid, round(min(d), 6) AS class_distance FROM (SELECT rid, lang, sqrt(greatest(sum({part}) / 2, 0.0e0)) AS d FROM (SELECT rid, k.lang, q, cls[i] / CAST(length(t) AS DOUBLE) AS p FROM base, kinds k WHERE length(t) >= {c.min_chars}) GROUP BY ALL) GROUP BY rid),
    windows AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
    again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM again, range(0, 5) r(j) GROUP BY rid),
    lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM base) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
    facts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '{Q.SYMBOLS}', '', 'g')) AS n_symbols,
        coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, class_distance, common_distance
        FROM base LEFT JOIN near ON near.rid = base.rid LEFT JOIN shapes ON shapes.rid = base.rid LEFT JOIN covered ON covered.rid = base.rid LEFT JOIN lines ON lines.rid = base.rid)
    SELECT *, n_words < {c.min_words} OR 100 * n_repeat_words > {c.most_repeat_percent} * n_words AS base_failed,
      NOT (n_words < {c.min_words} OR 100 * n_repeat_words > {c.most_repeat_percent} * n_words) AND coalesce(class_distance, 0) <= {c.most_class_distance} AND coalesce(common_distance, 0) <= {c.most_common_distance} AS kept FROM facts"""


def jaccard_join() -> str:
    """All pairs that share a shingle, compared in full, then reachability by a recursive query."""
    return rf"""
    WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{L.UPPER}', '{L.LOWER}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM docs),
    rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = s.doc_id"""


def revisits() -> str:
    """Captures spelled out, then the latest earlier response of each revisit by ``arg_max``."""
    allowed = _list(list(V.PERMITTED_HEADERS))
    host = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*')"
    url = lambda u: (
        f"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[^/?]*')), '^www\\.|:(?:80|443)$', '', 'g') || regexp_replace(regexp_extract({u}, '^[^/?]*([^?]*)', 1), '/+$', '') || "
        f"CASE WHEN q <> '' THEN '?' || q ELSE '' END, '^$', '')"
    )
    query = "regexp_replace(regexp_replace(regexp_extract(r, '\\?(.*)$', 1), '(?:^|&)" + V.TRACKING + "=[^&]*', '', 'g'), '^&+', '')"
    return rf"""
    WITH p AS (SELECT page_id AS p, CASE WHEN page_id IS NOT NULL THEN url END AS url, coalesce(html, '') AS h, substr(md5(coalesce(html, '')), 1, 16) AS tag, 'day ' || (page_id % 365) AS day FROM pages),
    raw AS (SELECT p * 4 AS record_id, url, p * 10 AS ts, 'response' AS kind, tag AS etag, day AS date, md5(h) AS digest, strlen(h)::VARCHAR AS size FROM p
      UNION ALL SELECT p * 4 + 1, url, CASE WHEN p % 11 = 0 THEN p * 10 - 5 ELSE p * 10 + 7 + p % 5 * 1000 END, 'revisit', CASE WHEN p % 13 = 0 THEN NULL WHEN p % 7 = 0 THEN 'stale' ELSE 'W/' || tag END, CASE WHEN p % 26 = 0 THEN NULL ELSE day END, NULL, '0' FROM p
      UNION ALL SELECT p * 4 + 2, {host} || '/robots.txt', p * 10 + 1, CASE WHEN p % 50 = 0 THEN 'response' ELSE 'revisit' END, 'robots-' || (p - p % 50), NULL, CASE WHEN p % 50 = 0 THEN 'robots-' || (p - p % 50) END, CASE WHEN p % 50 = 0 THEN strlen(h)::VARCHAR ELSE '0' END FROM p),
    cut AS (SELECT *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS r FROM raw), split AS (SELECT *, {query} AS q FROM cut), c AS (SELECT *, {url('r')} AS u FROM split),
    joined AS (SELECT v.record_id, v.u, v.ts, v.etag, v.date, arg_max(f, (f.ts, f.record_id)) AS f FROM c v LEFT JOIN c f ON f.kind = 'response' AND f.u = v.u AND (f.ts, f.record_id) < (v.ts, v.record_id) WHERE v.kind = 'revisit' GROUP BY ALL),
    judged AS (SELECT *, CASE WHEN f.record_id IS NULL THEN 'orphan' WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
      WHEN date IS NOT NULL THEN CASE WHEN date = f.date THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS outcome FROM joined)
    SELECT record_id, u AS canonical_url, ts, f.record_id AS target_id, outcome,
      CASE WHEN outcome = 'resolved' THEN concat_ws(chr(10), 'content-length: ' || f.size, 'date: ' || ts, 'etag: ' || coalesce(etag, f.etag), 'last-modified: ' || coalesce(date, f.date)) END AS headers,
      CASE WHEN outcome = 'resolved' THEN f.digest END AS payload_digest FROM judged WHERE len({allowed}) > 0"""


def sharding() -> str:
    return "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents"


def hard_negatives() -> str:
    """All anchors against all rows; sums of whole numbers are exact in doubles here."""
    return """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (SELECT DISTINCT a.vec_id AS a, a.label AS own, r.vec_id AS r, r.label, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS s FROM v a JOIN v r ON a.vec_id % 100 = 0 AND len(a.q) = len(r.q)),
    positives AS (SELECT a, own, r, s FROM scores WHERE label = own AND r <> a QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, r) <= 5)
    SELECT p.a AS anchor_id, p.r AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.r ORDER BY n.s DESC, n.r) AS INTEGER) AS rank, n.r AS negative_id, p.s AS positive_score, n.s AS negative_score
    FROM positives p JOIN scores n ON n.a = p.a AND n.label <> p.own AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
    QUALIFY row_number() OVER (PARTITION BY p.a, p.r ORDER BY n.s DESC, n.r) <= 10"""


def spelling_variants() -> str:
    """CRC-32 by its table; near words meet in what is left when one letter goes, at the same place (replaced) or as the shorter word (inserted)."""
    return r"""
    WITH RECURSIVE bits AS (SELECT b, 0 AS k, b AS c FROM (SELECT unnest(range(0, 256)) AS b) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{7,}')) AS w FROM documents),
    uses AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL),
    hexes AS (SELECT w, doc_id, n, hex(encode(doc_id || ':' || w)) AS x FROM uses),
    hashed AS (SELECT doc_id, w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS h FROM hexes, crc),
    edited AS (SELECT CASE WHEN h % 31 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM hashed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cut AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
    near AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, min((-n, near)) AS b FROM near GROUP BY word),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * w.n THEN -b[1] END AS form_n FROM words w LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(root, k) AS root FROM walk GROUP BY word) r ON r.word = f.word"""


def all_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan(), "op6_revisits": revisits(), "op8_quality_rules": quality_rules(), "op9_jaccard_join": jaccard_join(), "op10_sharding": sharding(), "op11_hard_negatives": hard_negatives(), "op13_spelling_variants": spelling_variants()}
