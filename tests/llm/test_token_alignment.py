"""Alignment of two tokenizers against a plain search over all pairs of token spans."""

import hashlib
from collections import Counter

import pytest

pt = pytest.importorskip("public_tokenizers")

from conftest import SF_TINY  # noqa: E402

from flawscope.llm.queries import QUERIES  # noqa: E402
from flawscope.llm.token_alignment import Alignment, byte_of  # noqa: E402

PATHS = pt.path("byte_bpe_50k.json"), pt.path("piece_bpe_32k.model")
TEXTS = [
    (1, "The quick brown fox."), (2, "The quick brown fox."), (2, "The quick brown fox."), (3, None), (4, ""),
    (5, "a <|endoftext|> b </s> <unk> <0x41>"), (6, "été naïve 😀 漢字 ­"), (7, "under▁score"), (8, "tabs\tand\n\nlines \r\n"),
    (None, "no id here"), (9, "  two  blanks  "), (10, " "), (11, "x" * 3000), (12, "word " * 20_000), (13, "\x00\x01"), (14, "１２３ ﬁ")]


def brute(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    ta.encode_special_tokens = True
    of, docs = byte_of(), []
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        ids = [ta.encode(" " + (text or ""), add_special_tokens=False).ids, list(tb.encode(text or ""))]
        tokens = [[bytes(of[c] for c in ta.id_to_token(x)) for x in ids[0]],
                  [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
                   for p in map(tb.id_to_piece, ids[1])]]
        if not text or any(b"".join(t) != raw for t in tokens):
            docs.append((i, [], [], "", Counter()))
            continue
        spans = []
        for side in (0, 1):
            at, here = 0, []
            for x, t in zip(ids[side], tokens[side]):
                here.append((at, at + len(t), x))
                at += len(t)
            spans.append(here)
        links, j = Counter(), 0
        for s, e, x in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links[x, spans[1][k][2]] += 1
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, before = [], 0
        at = [0, 0]
        for c in cuts:
            part = []
            for side in (0, 1):
                first = at[side]
                while at[side] < len(spans[side]) and spans[side][at[side]][1] <= c:
                    at[side] += 1
                part.append(",".join(str(x) for _, _, x in spans[side][first:at[side]]))
            groups.append("|".join(part))
            before = c
        assert before == len(raw)
        docs.append((i, ids[0], ids[1], ";".join(groups), links))
    held = Counter(p for *_, links in docs for p in links)
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = [(i, len(a), len(b), len(g.split(";")) if g else 0, sum(links.values()),
            sum(n for (x, y), n in links.items() if held[x, y] == most[x]), sum(n * held[p] for p, n in links.items()),
            hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, g, links in docs]
    return out, {(x, y, n, n == most[x]) for (x, y), n in held.items()}


def test_both_ways_to_encode_agree(spark):
    from tokenizers import Tokenizer

    from flawscope.llm.token_alignment import ODD, ByteLevel

    texts = [t for _, t in TEXTS if t] + ["a'll b'LL  c\u00a0d\u0085e\x1cf\x0b\x0c g", "¹²³¼ º·¿×÷ ŉ ǅ ƻ", "''s 's' 're\n\n x  "]
    texts += [r["text"] for r in spark.read.parquet(f"{SF_TINY}/documents.parquet").select("text").collect() if r["text"]]
    side = ByteLevel(open(PATHS[0], encoding="utf-8").read())
    ta = Tokenizer.from_file(PATHS[0])
    ta.encode_special_tokens = True
    assert side.fast is not None and any(ODD.search(t) for t in texts) and not all(ODD.search(t) for t in texts)
    for got, t in zip(side.encode(texts), texts):
        assert got == ta.encode(" " + t, add_special_tokens=False).ids, t[:50]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 5])  # one chunk, and pairs counted over several
def test_against_spans(spark, parts):
    rows, pairs = brute(TEXTS)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in TEXTS], "doc_id long, text string, chunk int, pair int, n int")
    found = Alignment(docs.repartition(parts), *PATHS)
    assert rows_of(found.documents()) == sorted(rows, key=repr)
    assert {tuple(r) for r in found.pairs().collect()} == pairs
    empty = {r[0] for r in rows if r[1] == 0}
    assert {3, 4, 7} <= empty and not empty & {1, 2, 5, 8, 11, 12}


def test_query_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    want, _ = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(QUERIES["op13_token_alignment"](spark, SF_TINY)) == sorted(want, key=repr)


def test_empty_table_and_only_empty_texts(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert Alignment(docs.limit(0), *PATHS).documents().count() == 0
    only = Alignment(docs.where("doc_id in (3, 4)"), *PATHS)
    assert rows_of(only.documents()) == [(3, 0, 0, 0, 0, 0, 0, ""), (4, 0, 0, 0, 0, 0, 0, "")]
    assert only.pairs().count() == 0
