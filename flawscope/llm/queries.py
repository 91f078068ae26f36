"""The registered queries of this package, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------------ op1 substring dedup

SUBSTRING_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
wins AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM wins GROUP BY k),
late AS (SELECT DISTINCT doc_id, i FROM wins JOIN firsts USING (k) WHERE doc_id > first_doc),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps
         FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM late) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ')
              ELSE array_to_string([ws[p] FOR p IN range(1, len(ws) + 1) IF NOT list_contains(ps, p)], ' ') END, ''))
         AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)"""


@query("op1_substring_dedup", sql=SUBSTRING_SQL)
def op1_substring_dedup(spark, sf_dir):
    from flawscope.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), window=13, keep_text=False).drop("kept_text")


# ----------------------------------------------------------------------- op5 near duplicates

NEAR_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
           ELSE [array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)] END) AS s FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
few AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM few JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS c FROM documents
          UNION SELECT both_ways.b, reach.c FROM reach JOIN both_ways ON both_ways.a = reach.a),
comp AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.c AS component_id,
       w.doc_id = comp.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN comp ON comp.a = w.doc_id"""


@query("op5_minhash_near_dedup", sql=NEAR_SQL)
def op5_minhash_near_dedup(spark, sf_dir):
    from flawscope.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85, chunks=16, width=6)


# ---------------------------------------------------------------- op2 benchmark decontamination

_ALNUM_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
CONTAMINATION_SQL = rf"""
WITH iw AS (SELECT item_id, {_ALNUM_WORDS} AS ws FROM benchmark),
it AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(ws)) AS t, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM iw WHERE len(ws) > 0)),
dw AS MATERIALIZED (SELECT doc_id, {_ALNUM_WORDS} AS ws FROM documents),
ts AS (SELECT DISTINCT t FROM it),
win AS (SELECT doc_id, t, i, array_to_string(ws[i:i + t - 1], ' ') AS k
        FROM (SELECT doc_id, ws, t, unnest(range(1, len(ws) - t + 2)) AS i FROM dw, ts WHERE len(ws) >= t)),
hit AS MATERIALIZED (SELECT doc_id, i, win.t, item_id FROM win JOIN it ON it.t = win.t AND it.k = win.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + t)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op2_benchmark_decontamination", sql=CONTAMINATION_SQL)
def op2_benchmark_decontamination(spark, sf_dir):
    from flawscope.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


# ------------------------------------------------------------------------ op7 language ID

@query("op7_ppm_language_id")
def op7_ppm_language_id(spark, sf_dir):
    from flawscope.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents")).drop("bits_per_byte")


# ----------------------------------------------------------------------- op9 best-fit packing

@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir):
    from pyspark.sql import functions as F

    from flawscope.llm.near_dedup import near_duplicates
    from flawscope.llm.packing import best_fit_measured

    # one pass over the texts: their words are counted where their near copies are looked for
    near = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85, chunks=16, width=6, measure=("source",))
    return best_fit_measured(near.select("doc_id", "source", F.col("component_id").alias("given"),
                                         (F.col("n_words") + 1).alias("tokens"),
                                         F.when(F.col("same").isNotNull(), F.xxhash64("same")).alias("cluster")), capacity=2048)


# --------------------------------------------------------------------------- op3 LM scoring

@query("op3_hmm_lm_scoring")
def op3_hmm_lm_scoring(spark, sf_dir):
    from flawscope.llm.hmm_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ op6 document fingerprints

@query("op6_quartile_digest")
def op6_quartile_digest(spark, sf_dir):
    from flawscope.llm.quartile_digest import quartile_digests

    return quartile_digests(table(spark, sf_dir, "documents"))


# --------------------------------------------------------------------------------- op8 WARC

WARC_SQL = r"""
WITH p AS MATERIALIZED (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
last AS (SELECT hex, max(page_id) AS last_id FROM p GROUP BY hex)
SELECT page_id, payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST(('0x' || substr(hex, 5 * (i // 4) + 1, 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)
           FOR i IN range(0, 32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM p JOIN last USING (hex)"""


@query("op8_warc_dictionary", sql=WARC_SQL)
def op8_warc_dictionary(spark, sf_dir):
    from flawscope.llm.warc import read_warc, write_warc
    from flawscope.session import scratch_dir

    path = scratch_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return read_warc(spark, path).drop("url", "payload")


# -------------------------------------------------------------------------- op10 URL filters

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]
SPAM_HOST = r"(^|\.)(cheap-pills|ads-track)\."

URL_SQL = r"""
WITH u AS MATERIALIZED (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
h AS MATERIALIZED (
  SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
c AS MATERIALIZED (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canon,
                          row_number() OVER () AS row FROM h),
listed AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\.)(cheap-pills|ads-track)\.') AND canon <> ''),
rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                             ('org', '/fr/', 'allow')),
best AS (SELECT row, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
         FROM c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY row)
SELECT page_id, host, path, rule,
       coalesce(rv, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       listed.canon IS NOT NULL AS listed
FROM c LEFT JOIN best USING (row) LEFT JOIN listed ON c.canon = listed.canon"""


@query("op10_url_filter", sql=URL_SQL)
def op10_url_filter(spark, sf_dir):
    from pyspark.sql import functions as F

    from flawscope.llm.url_filter import filter_urls, host_of, rule_rows

    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.regexp_like(host_of("url"), F.lit(SPAM_HOST))).select("url")
    return filter_urls(pages, rule_rows(spark, RULES), listed)


# --------------------------------------------------------------------------- op4 license scan

_WORDS = r"[x FOR x IN regexp_split_to_array(lower(coalesce({t}, '')), '[^\p{{L}}\p{{N}}]+') IF x <> '']"
_PAIRS = ("CASE WHEN len(ws) >= 2 THEN [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] "
          "WHEN len(ws) = 1 THEN ws ELSE [] END")


def _license_sql(templates: list[tuple[str, str]]) -> str:
    """Every start position counted, then the places of a chain of overlapping ones taken best first."""
    values = ", ".join("({}, '{}', '{}')".format(t, k, v.replace("'", "''")) for t, (k, v) in enumerate(templates))
    both = "greatest(0, least(q.e, o.e) - greatest(q.a, o.a))"
    other = "(q.license <> o.license AND (q.n <> o.n_found OR q.m <> o.m))"
    return f"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT t, license, list_distinct(s) AS template, len(list_distinct(s)) AS m, (len(s) * 100 + 79) // 80 AS reach
  FROM (SELECT t, license, {_PAIRS} AS s
        FROM (SELECT t, license, {_WORDS.format(t="notice")} AS ws FROM (VALUES {values}) v(t, license, notice)))),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, s
  FROM (SELECT DISTINCT doc_id, text, {_PAIRS} AS s
        FROM (SELECT doc_id, text, {_WORDS.format(t="text")} AS ws FROM documents))),
th AS (SELECT t, reach, unnest(template) AS h FROM t),
hits AS MATERIALIZED (
  SELECT r, p, h, t, reach FROM (SELECT r, unnest(s) AS h, unnest(range(0, len(s))) AS p FROM d) JOIN th USING (h)),
firsts AS (
  SELECT x.r, x.t, x.p AS a, y.h, min(y.p) AS p
  FROM (SELECT DISTINCT r, t, p, reach FROM hits) x JOIN hits y ON x.r = y.r AND x.t = y.t AND y.p >= x.p AND y.p < x.p + x.reach
  GROUP BY ALL),
places AS MATERIALIZED (
  SELECT f.r, f.t, t.license, t.m, f.a, max(f.p) + 1 AS e, count(*) AS n_found, list(f.h) AS held
  FROM firsts f JOIN t USING (t) GROUP BY ALL HAVING count(*) * 100 >= t.m * 80),
rivals AS (
  SELECT x.t, list([h FOR h IN x.template IF NOT list_contains(y.template, h)]) AS apart
  FROM t x JOIN t y ON x.license <> y.license
  WHERE len(list_intersect(x.template, y.template)) * 100 >= x.m * 80
    AND len(list_intersect(x.template, y.template)) < x.m GROUP BY x.t),
told AS (
  SELECT p.*, len([u FOR u IN coalesce(apart, []) IF NOT list_has_any(u, held)]) = 0 AS told
  FROM places p LEFT JOIN rivals USING (t)),
chained AS (
  SELECT *, sum(CASE WHEN a < before THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY a, e, t) AS chain
  FROM (SELECT *, max(e) OVER (PARTITION BY r ORDER BY a, e, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM told)),
o AS MATERIALIZED (
  SELECT r, chain, license, a, e, n_found, m, told,
         row_number() OVER (PARTITION BY r, chain ORDER BY n_found DESC, m, e - a, a, e, license, told) AS i FROM chained),
k AS (
  SELECT r, chain, 1 AS i, [{{'license': license, 'a': a, 'e': e, 'n': n_found, 'm': m, 'told': told}}] AS kept FROM o WHERE i = 1
  UNION ALL
  SELECT o.r, o.chain, k.i + 1, CASE
    WHEN len([1 FOR q IN k.kept IF (q.license = o.license AND {both} > 0)
              OR ({other} AND 2 * {both} >= least(q.e - q.a, o.e - o.a))]) > 0
      OR 2 * coalesce(list_sum([{both} FOR q IN k.kept IF {other}]), 0) >= o.e - o.a THEN k.kept
    ELSE list_append(k.kept, {{'license': o.license, 'a': o.a, 'e': o.e, 'n': o.n_found, 'm': o.m, 'told': o.told}}) END
  FROM k JOIN o ON o.r = k.r AND o.chain = k.chain AND o.i = k.i + 1),
best AS (SELECT r, kept, unnest(kept) AS x FROM (SELECT r, chain, max_by(kept, i) AS kept FROM k GROUP BY r, chain)),
ends AS (
  SELECT r, x.license AS license, x.n AS n, x.m AS m, x.told AND len([1 FOR q IN kept IF q.license <> x.license
    AND 2 * greatest(0, least(q.e, x.e) - greatest(q.a, x.a)) >= least(q.e - q.a, x.e - x.a)]) = 0 AS sure FROM best)
SELECT doc_id, license, count(*) AS n_places, CAST(max(n) AS BIGINT) AS n_found,
       CAST(arg_min(m, (-n, m)) AS BIGINT) AS n_shingles, bool_or(sure) AS sure
FROM ends JOIN d USING (r) GROUP BY r, doc_id, license"""


def _templates():
    from flawscope.llm.license_scan import TEMPLATES

    return TEMPLATES


@query("op4_license_scan", sql=_license_sql(_templates()))
def op4_license_scan(spark, sf_dir):
    from flawscope.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


@query("license_matches")
def license_matches(spark, sf_dir):
    from flawscope.llm.license_scan import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


# -------------------------------------------------------------------- op11 filter interaction audit

AUDIT_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first_doc FROM documents GROUP BY 1),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS MATERIALIZED (
  SELECT part, CAST(len(ws) < 100 AS INT) AS a, CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT) AS b,
         CAST(100 * len(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t) AS INT) AS c,
         CAST(regexp_matches(w.t, '[#$%&*|]') AS INT) AS d,
         CAST(coalesce(w.doc_id > first_doc, false) AS INT) AS e,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w JOIN firsts ON firsts.t = w.t LEFT JOIN marks ON marks.doc_id = w.doc_id),
cells AS MATERIALIZED (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f GROUP BY 1, 2),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
orders AS (
  SELECT [p.x, q.x, r.x, s.x, t.x] AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
judged AS (
  SELECT part, o, step, n, good, toxic, fails[o[step]] = 1 AS fail,
         list_sum([fails[x] FOR x IN o[1:step - 1]]) AS before, list_sum(fails) AS total
  FROM cells, steps),
seen AS (SELECT part, o, step, n, good, toxic, fail, total, coalesce(before, 0) > 0 AS gone FROM judged),
res AS (
  SELECT part, o, step, o[step] AS x, CAST(sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN fail AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN fail AND total = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN fail AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN fail AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, array_to_string([substr('ABCDE', i, 1) FOR i IN o], '') AS filter_order, CAST(step AS INTEGER) AS step,
       substr('ABCDE', x, 1) AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM res"""


@query("op11_filter_audit", sql=AUDIT_SQL)
def op11_filter_audit(spark, sf_dir):
    from flawscope.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ------------------------------------------------------------------------ op12 n-gram Jaccard join

JACCARD_SQL = NEAR_SQL.replace("100 * shared >= 85 *", "100 * shared >= 90 *").replace("""comp.c AS component_id,
       w.doc_id = comp.c AS kept""", "comp.c AS component_id")


@query("op12_ngram_jaccard_join", sql=JACCARD_SQL)
def op12_ngram_jaccard_join(spark, sf_dir):
    from flawscope.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), shingle=3, percent=90)


# ------------------------------------------------------------------- op13 cross-tokenizer alignment

@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    import public_tokenizers

    from flawscope.llm.token_alignment import Alignment

    return Alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                     public_tokenizers.path("piece_bpe_32k.model")).documents()


# --------------------------------------------------------------------------------- pipeline

@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
