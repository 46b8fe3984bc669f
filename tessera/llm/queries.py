"""The registered queries of the corpus operators: (spark, sf_dir) to a DataFrame, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embeddings, features_at, langid, merkle, mixing, periodic, pii, secrets, simhash, suffixes, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.identify(docs, docs.where(~held_out()))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives, against a replica that this query damages: bytes changed, records lost."""
    pages = table(spark, sf_dir, "pages")
    html = F.when(F.col("page_id") % 13 == 5, F.concat(F.col("html"), F.lit(" "))).when(F.col("page_id") % 17 == 4, F.translate("html", "e", "3")).otherwise(F.col("html"))
    replica = pages.where("page_id % 19 <> 7").withColumn("html", html)
    got = merkle.audit(merkle.records(pages), merkle.records(replica))
    return got.select((F.col("archive") * 4096 + F.col("slot")).alias("page_id"), "archive", "offset", "length", "status", "sha256", "replica_sha256")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s[0], s[1])), ",")
    return got.select("doc_id", "n_words", "n_repeat", spans.alias("spans"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False)
    return got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _counts(kinds: tuple[str, ...]) -> list:
    def of(kind: str):
        # A lambda with a second parameter would be given the element's index.
        return F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    return [of(k) for k in kinds]


def _digests() -> list:
    return [F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans")]


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find_pii(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *_counts(pii.KINDS), *_digests())


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *_counts(secrets.KINDS), *_digests())


def op11_features_at_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sale is looked at up to three days after it, by the CRC-32 of its id."""
    sales, clicks, lines = (table(spark, sf_dir, t) for t in ("sales", "clicks", "sale_lines"))
    return features_at.features_at(sales, clicks, lines, F.crc32(F.col("sale_id").cast("string").cast("binary")) % 259200 * features_at.SECOND)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic.planted_runs(table(spark, sf_dir, "documents"))
    return got.withColumn("exponent_milli", F.expr("1000 * length div period")).drop("n_words")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_merkle_fixity, op3_decontamination, op4_embedding_groups, op5_repeated_passages, op6_bpe, op7_pii, op8_url_filter, op9_simhash, op10_secrets, op11_features_at_sale, op12_periodic_runs, op13_source_mix)}

_UPPER, _LOWER = urls.UPPER, urls.LOWER

_OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, widths WHERE len(w) >= n)),
m AS (SELECT doc_id, item, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _op8_sql() -> str:
    """From the same rule parameters, with the rules as joins instead of an automaton."""
    rules = ", ".join(f"({i}, '{r.action}', '{r.host}', '{r.path}')" for i, r in enumerate(urls.RULES))
    bad = " OR ".join(f"'.' || host || path LIKE '{g.replace('*', '%')}'" for g in urls.BLOCKED)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(k, action, h, s) AS (VALUES {rules}),
f AS (SELECT p.*, r.h || r.s AS rule, r.action, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.s) DESC, k) AS n
      FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.s))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN action WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict FROM f WHERE n = 1
"""


_OP2_SQL = """
WITH a AS (SELECT page_id, url, html FROM pages),
b AS (SELECT page_id, url, CASE WHEN page_id % 13 = 5 THEN html || ' ' WHEN page_id % 17 = 4 THEN translate(html, 'e', '3') ELSE html END AS html FROM pages WHERE page_id % 19 <> 7),
ra AS (SELECT page_id, 'url ' || coalesce('=' || url, '-') || chr(10) || coalesce('=' || html, '-') AS body FROM a),
rb AS (SELECT page_id, 'url ' || coalesce('=' || url, '-') || chr(10) || coalesce('=' || html, '-') AS body FROM b),
oa AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS length, sha256(body) AS sha256,
              CAST(coalesce(sum(strlen(body)) OVER (PARTITION BY page_id // 4096 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM ra)
SELECT page_id, page_id // 4096 AS archive, "offset", length, CASE WHEN rb.body IS NULL THEN 'missing' ELSE 'corrupt' END AS status, oa.sha256 AS sha256, sha256(rb.body) AS replica_sha256
FROM oa LEFT JOIN rb USING (page_id) WHERE rb.body IS NULL OR sha256(rb.body) <> oa.sha256
"""

_OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


#: CRC-32 by its table of 256 remainders, made by SQL itself; then plain joins by client and window.
_OP11_SQL = """
WITH tab AS (SELECT list(c ORDER BY i) AS r FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i))),
ids AS (SELECT sale_id, list_concat([4294967295], list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))) AS b FROM (SELECT DISTINCT sale_id FROM sales WHERE sale_id IS NOT NULL)),
crc AS (SELECT sale_id, xor(list_reduce(b, lambda c, x: xor(c // 256, r[CAST(xor(c % 256, x) AS BIGINT) + 1])), 4294967295) AS crc FROM ids, tab),
s AS (SELECT row_number() OVER () AS rid, sale_id, client_id, epoch_us(sold_at) AS sold, epoch_us(arrived_at) AS came, CASE WHEN total IS NULL OR NOT isfinite(total) THEN 0 ELSE CAST(floor(100 * total + 0.5) AS BIGINT) END AS v
      FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT rid, sale_id, client_id, sold + coalesce(crc, 0) % 259200 * 1000000 AS t FROM s LEFT JOIN crc USING (sale_id)),
w AS (SELECT rid, p.sale_id, client_id, t, d, t - d * 86400000000 AS since FROM p, (VALUES (2), (14)) x(d)),
k AS (SELECT click_id, client_id, kind, epoch_us(ts) AS ts, epoch_us(arrived_at) + 14400000000 AS came, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0 ELSE CAST(floor(100 * value + 0.5) AS BIGINT) END AS v FROM (SELECT DISTINCT * FROM clicks)),
a AS (SELECT rid, d, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(v) AS click_cents, first(click_id ORDER BY ts DESC, click_id DESC NULLS LAST) AS last_click_id
      FROM w JOIN k ON k.client_id = w.client_id AND ts > since AND ts <= t AND came <= t GROUP BY rid, d),
z AS (SELECT w.rid, d, t, s.sale_id, s.v FROM w JOIN s ON s.client_id = w.client_id AND sold > since AND sold <= t AND came + 14400000000 <= t),
b AS (SELECT rid, d, count(*) AS n_sales, sum(v) AS sale_cents FROM z GROUP BY rid, d),
l AS (SELECT rid, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(CASE WHEN amount IS NULL OR NOT isfinite(amount) THEN 0 ELSE CAST(floor(100 * amount + 0.5) AS BIGINT) END) AS line_cents
      FROM z JOIN sale_lines i ON i.sale_id = z.sale_id AND epoch_us(shipped_at) <= t GROUP BY rid, d),
y AS (SELECT DISTINCT p.rid FROM p JOIN s ON s.client_id = p.client_id AND sold > t AND sold <= t + 7 * 86400000000)
SELECT w.sale_id, CAST(d AS INTEGER) AS d, t AS t_us, y.rid IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents, last_click_id,
       coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM w LEFT JOIN a USING (rid, d) LEFT JOIN b USING (rid, d) LEFT JOIN l USING (rid, d) LEFT JOIN y ON y.rid = w.rid
"""


def _op13_sql() -> str:
    """Targets by the level that meets limits; two fillings by rank and the closing document, with windows over whole sources."""
    weights, bits = list(mixing.WEIGHTS), mixing.BITS

    def fill(k: int) -> str:
        """Rows not taken before that fit, the first rank beyond the words left, and what then is left."""
        return f"""
c{k} AS (SELECT r{k}.*, CASE WHEN NOT took AND place IS NOT NULL AND size > 0 AND size <= lft THEN sum(CASE WHEN NOT took AND place IS NOT NULL AND size > 0 AND size <= lft THEN size END) OVER (PARTITION BY name ORDER BY place NULLS LAST RANGE UNBOUNDED PRECEDING) END AS upto FROM r{k}),
k{k} AS (SELECT *, coalesce(upto <= lft, false) AS now FROM c{k}),
r{k + 1} AS (SELECT name, source, doc_id, size, source_size, target, whole, place, took OR now AS took, lft - coalesce(sum(CASE WHEN now THEN size END) OVER (PARTITION BY name), 0) AS lft FROM k{k})"""

    return f"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '-') AS name, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
           (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {bits // 4}) AS BIGINT) + 0.5::DOUBLE) / {1 << bits}::DOUBLE AS u FROM documents),
s AS (SELECT name, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, CAST({mixing.MOST} * source_size AS BIGINT) AS lim, {weights}[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)} + 1] AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () AS whole_size, coalesce(sum(lim) OVER (ORDER BY lim / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY lim / weight, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
f AS (SELECT *, lim * rest <= (whole_size - before) * weight AS is_full FROM o),
g AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN lim END) OVER (), 0) AS spent, sum(CASE WHEN NOT is_full THEN weight END) OVER () AS open_weight FROM f),
t AS (SELECT name, source_size, CASE WHEN is_full THEN CAST(lim AS DOUBLE) ELSE CAST((whole_size - spent) * weight AS DOUBLE) / open_weight END AS target FROM g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(0, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size) AS lft FROM p),
x AS (SELECT d.*, source_size, target, whole, lft, CASE WHEN lft > 0 AND lft < source_size THEN (u / (1 - u)) / ((lft / source_size) / (1 - lft / source_size)) END AS odds FROM d JOIN q USING (name)),
r1 AS (SELECT *, CAST(floor(odds / (1 + odds) * {1 << bits}::DOUBLE) AS BIGINT) AS place, false AS took FROM x),{fill(1)},{fill(2)},
near AS (SELECT name, place, sum(size) AS size, any_value(lft) AS lft FROM r3 WHERE NOT took AND place IS NOT NULL AND size > 0 AND size < 2 * lft GROUP BY name, place),
last AS (SELECT name, place AS last FROM near WHERE size < 2 * lft QUALIFY row_number() OVER (PARTITION BY name ORDER BY abs(size - lft), place) = 1)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN size > 0 AND (took OR (coalesce(place = last, false) AND size < 2 * lft)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r3 LEFT JOIN last USING (name)
"""


SQL = {"op11_features_at_sale": _OP11_SQL, "op13_source_mix": _op13_sql(), "op2_merkle_fixity": _OP2_SQL, "op4_embedding_groups": _OP4_SQL, "op3_decontamination": _OP3_SQL, "op8_url_filter": _op8_sql()}
