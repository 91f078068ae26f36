"""URL filter: a blocked Bloom filter of listed keys in front of an exact hash join.

Rules (host, path, verdict) and listed canonical URLs are strings "host/path".  A URL asks for
every string that could be listed: its host's suffixes with its path's prefixes (as many
labels and as long as any rule has), and its own canonical form.  A blocked Bloom filter (blocks
of 256 bits; one bit in each of a block's four words) throws out almost all of them; what passes is
joined exactly with the list.  The filter has a block for ``PER_BLOCK`` keys, so that about 2 of
10,000 strangers pass, up to ``MAX_BLOCKS`` blocks: that bounds what is broadcast; a list of more than
8 million keys passes more strangers (3 of 100 at 36 million) and loses nothing.

All work is done in DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flawscope.session import materialize

PER_BLOCK = 8         # keys of the list for each block
MAX_BLOCKS = 1 << 20  # blocks of 4 words: 42 MB with their numbers
SALTS = 8             # a rule that fits a third of all URLs is joined in so many parts

AFTER_SCHEME = r"(?s)^.*?://(.*)$"


def host_of(url) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    u = F.col(url) if isinstance(url, str) else url
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), upper, lower)
    return F.coalesce(F.when(F.instr(u, "://") > 0, host), F.lit(""))


def path_of(url) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    u = F.col(url) if isinstance(url, str) else url
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(F.instr(u, "://") > 0, path), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and path without a closing ``/``; scheme, query and fragment go."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key and its bit in each of the block's four words."""
    h = F.xxhash64(key)
    other = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    words = [F.call_function("shiftleft", one, (F.shiftrightunsigned(other, 6 * w).bitwiseAND(F.lit(63))).cast("int"))
             for w in range(4)]
    return F.pmod(h, F.lit(blocks)).cast("int"), words


def block_number(n_keys: int) -> int:
    """Blocks for so many keys, a power of two."""
    return min(MAX_BLOCKS, 1 << max(0, (n_keys - 1) // PER_BLOCK).bit_length())


def bloom(keys: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """(block, w0..w3) of all keys: at most ``blocks`` rows."""
    block, words = _bits(F.col(key), blocks)
    return (keys.select(block.alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words)))
            .groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4))))


def passing(asked: DataFrame, keys: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """The rows of ``asked`` whose key may be among ``keys`` (never loses one that is)."""
    block, words = _bits(F.col(key), blocks)
    cols = asked.columns
    asked = asked.select("*", block.alias("block"), *(w.alias(f"b{i}") for i, w in enumerate(words)))
    hit = F.lit(True)
    for i in range(4):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) != 0)
    return asked.join(F.broadcast(bloom(keys, blocks, key)), "block").where(hit).select(*cols)


def rule_rows(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows of a list of rules."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, listed.

    ``rules`` are (host, path, verdict): a rule fits its host and all subdomains of it if the
    URL's path starts with the rule's; the longest host and path win (of equal ones the longer
    host, then the smaller verdict).  Without a rule a URL is blocked if ``listed`` (url) has
    one of the same canonical form, else allowed.

    A null url or one without ``://`` has an empty host and path, fits no rule and is not
    listed.  Null rules and listed nulls fit nothing.  Repeated rows come back each; extra
    columns are ignored.  Rules and list may be empty.
    """
    rows = pages.select("page_id", "url", host_of("url").alias("host"), path_of("url").alias("path"))
    rules = rules.where("host is not null and path is not null and verdict is not null") \
        .select("host", "path", "verdict").distinct()
    sizes = rules.agg(F.collect_set(F.length("path")).alias("paths"),
                      F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    keys = rules.select(F.concat("host", "path").alias("key"), F.col("host").alias("rule_host"), "verdict",
                        F.lit(False).alias("listed"))
    own = canonical(host_of("url"), path_of("url"))
    in_list = (listed.select(own.alias("key")).where("key <> ''").distinct()
               .select("key", F.lit("").alias("rule_host"), F.lit("block").alias("verdict"), F.lit(True).alias("listed")))
    every = materialize(keys.unionByName(in_list), "table")  # counted, put into the filter and joined
    blocks = block_number(every.count())

    # questions of each distinct host and path: (host, path, key, rule_host or '' for the list)
    urls = rows.where("host <> ''").select("host", "path").distinct()
    urls = urls.withColumn("labels", F.split("host", r"\."))
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size("labels") - F.lit((sizes["labels"] or 1) - 1)), F.size("labels")),
        lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    lengths = F.array(*(F.lit(x) for x in sorted(sizes["paths"]))) if sizes["paths"] else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = F.flatten(F.transform(suffixes, lambda h: F.transform(
        prefixes, lambda p: F.struct(F.concat(h, p).alias("key"), h.alias("rule_host")))))
    mine = F.array(F.struct(canonical(F.col("host"), F.col("path")).alias("key"), F.lit("").alias("rule_host")))
    asked = urls.select("host", "path", F.explode(F.concat(asked, mine)).alias("a")).select("host", "path", "a.*").where("key <> ''")

    # a rule fits many URLs, so it is joined in parts; a listed URL is asked for by its few spellings
    salts = F.when(F.col("listed"), F.array(F.lit(0))).otherwise(F.array(*(F.lit(i) for i in range(SALTS))))
    part = F.when(F.col("rule_host") == "", F.lit(0)).otherwise(F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    hits = (passing(asked, every, blocks).withColumn("salt", part)
            .join(every.withColumn("salt", F.explode(salts)), ["key", "rule_host", "salt"]))
    best = F.struct(F.length("key").alias("n"), F.length("rule_host").alias("h"))
    won = hits.groupBy("host", "path").agg(
        F.max_by(F.struct("key", "verdict"), F.when(~F.col("listed"), F.struct(
            best.n, best.h, (F.col("verdict") == "allow").alias("tie")))).alias("rule"),
        F.max("listed").alias("listed"))
    found = F.coalesce("listed", F.lit(False))
    return (rows.join(won, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("rule.key").alias("rule"),
                    F.coalesce(F.col("rule.verdict"), F.when(found, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    found.alias("listed")))
