"""Token alignment against a plain version that encodes whole texts and compares all byte ranges."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidelake.llm import token_alignment
from tidelake.llm.bpe_codec import byte_of_character

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """Rows of (doc_id, text), by whole texts and Python loops."""
    a, b, table = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_of_character()
    a.encode_special_tokens = True
    held, docs = Counter(), []
    for doc_id, text in rows:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        tokens_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids[0]]
        names = [b.id_to_piece(i) for i in ids[1]]
        tokens_b = [bytes([int(x[3:5], 16)]) if b.is_byte(i) else x.replace("▁", " ").encode() for i, x in zip(ids[1], names)]
        if not text or b"".join(tokens_a) != (" " + text).encode() or b"".join(tokens_b) != (" " + text).encode():
            docs.append((doc_id, [], [], [], []))
            continue
        ranges = []
        for tokens in (tokens_a, tokens_b):
            at, out = 0, []
            for x in tokens:
                out.append((at, at + len(x)))
                at += len(x)
            ranges.append(out)
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        lists = [defaultdict(list), defaultdict(list)]
        for k in (0, 1):
            for i, (_, e) in zip(ids[k], ranges[k]):
                lists[k][bisect_left(cuts, e)].append(str(i))
        groups = ["|".join(",".join(lists[k][g]) for k in (0, 1)) for g in range(len(cuts))]
        links, first = [], 0
        for i, (s, e) in zip(ids[0], ranges[0]):
            while ranges[1][first][1] <= s:
                first += 1
            k = first
            while k < len(ids[1]) and ranges[1][k][0] < e:
                links.append((i, ids[1][k]))
                k += 1
        held.update(set(links))
        docs.append((doc_id, ids[0], ids[1], groups, links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = [(d, len(x), len(y), len(g), len(ls), sum(held[p] == most[p[0]] for p in ls), sum(held[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for d, x, y, g, ls in docs]
    return out, held


TEXTS = [
    None, "", " ", "a", "It's  the\n\n  end's", "x" * 3000, "word " * 3000, "a<|endoftext|>b <|endoftext|> <s>x</s> <unk> <0x41>", "中文 テスト ２３   x", "é É İ ς Σ K ﬁ Å", "🙂🙂 \U0001fae8 \U00010d4a Ᲊ", "''s 'S 's't",
    "tabs\t\tand\r\nlines ", "1234 5678", "same", "same", "under ▁ score", "x▁y", "no break   x 　y", "a\x00b \x1c c", " lead", "trail ", "two  spaces", "antidisestablishmentarianism tokenization",
]


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize("partitions", [1, 8])
def test_odd_texts_equal_the_plain_version(spark, partitions):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id bigint, text string, block string, n_a int").repartition(partitions)
    aligned, tables = token_alignment.align(docs, A, B, buckets=5, lists_per_salt=2)
    want, held = plain(rows)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in aligned.collect()), key=key) == sorted(want, key=key)
    assert {(r["id_a"], r["id_b"]): r["n_docs"] for r in token_alignment.pair_counts(tables).collect()} == held


def test_blocks_of_a_few_documents_add_up():
    known = token_alignment.table(A, B)
    rows = [(i, t) for i, t in enumerate(TEXTS) if t]
    one = token_alignment._block("x", pa.array(range(len(rows))), [t for _, t in rows], known, 4)
    for k, (_, text) in enumerate(rows):
        alone = token_alignment._block("x", pa.array([k]), [text], known, 4)
        for c in ("n_a", "n_b", "n_groups", "n_links", "sha"):
            assert alone[c][0].as_py() == [one[c][0].as_py()[k]]


def test_query_equals_the_plain_version(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in token_alignment.op12_token_alignment(spark, sf_dir).collect()]
    assert sorted(got, key=key) == sorted(plain(rows)[0], key=key)


def test_empty_table(spark):
    aligned, tables = token_alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), A, B)
    assert aligned.count() == 0
    assert tables.count() == 0
