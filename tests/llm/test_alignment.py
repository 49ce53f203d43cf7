"""Alignment of two tokenizers against whole-text encoding and plain loops."""

import collections
import hashlib

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from formloom.llm import alignment

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, n_a string, lot int, pos int, c0 int, pairs string"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces and\ttabs \n\n lines "), (5, "plain words, again plain words"), (6, "plain words, again plain words"),
    (6, "plain words, again plain words"), (None, "no id"), (None, None), (7, "sign ▁ of a space"), (8, "<|endoftext|> <s> </s> <0x41> <unk>"),
    (9, "日本語のテキスト 🙂🙂 é é \x00\x1c\x85 \xa0x  "), (10, "aaaa" * 3000), (11, " ".join(f"w{i % 97}" for i in range(6000))), (12, "　wide 　 space\n x"),
]


def brute(rows):
    """Groups by the ends that both sides share, links pair by pair."""
    a, b = Tokenizer.from_file(alignment.BYTE_FILE), SentencePieceProcessor(model_file=alignment.PIECE_FILE)
    a.encode_special_tokens = True
    signs = alignment.byte_of_sign()
    names = {i: bytes(signs.get(c, 0) for c in t) for t, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, holders = [], collections.Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a, bytes_b = [names[i] for i in ids_a], [piece(i) for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            out.append((doc_id, [], [], None))
            continue
        ends = []
        for sizes in (bytes_a, bytes_b):
            at, own = 0, []
            for x in sizes:
                at += len(x)
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = []
        i = j = 0
        for cut in cuts:
            k, m = i, j
            while k < len(ids_a) and ends[0][k] <= cut:
                k += 1
            while m < len(ids_b) and ends[1][m] <= cut:
                m += 1
            groups.append((ids_a[i:k], ids_b[j:m]))
            i, j = k, m
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        holders.update(set(links))
        out.append((doc_id, ids_a, ids_b, (groups, links)))
    highest = collections.Counter()
    for (x, _), n in holders.items():
        highest[x] = max(highest[x], n)
    result = []
    for doc_id, ids_a, ids_b, found in out:
        if found is None:
            result.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = found
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        best = sum(holders[p] == highest[p[0]] for p in links)
        digest = hashlib.sha256(text.encode()).hexdigest()
        result.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links), best, sum(holders[p] for p in links), digest))
    return sorted(result, key=str)


def got(docs):
    rows, n = alignment.aligned(docs)
    return sorted((tuple(r[c] for c in ("doc_id", *[n[c] for c in alignment.ADDED])) for r in rows.collect()), key=str)


def test_alignment_odd(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in ODD], SCHEMA)
    assert got(docs) == brute(ODD)
    rows, n = alignment.aligned(docs)
    assert n["n_a"] != "n_a" and [c for c in docs.columns if c != "text"] == rows.columns[:6]
    assert {(r["n_a"], r["lot"], r["c0"]) for r in rows.collect()} == {("x", 1, 3)}
    assert got(docs.limit(0)) == []
    monkeypatch.setattr(alignment, "LOT_ROWS", 3)  # lots are cut the same way by characters
    monkeypatch.setattr(alignment, "SLICE", 7)
    assert got(docs.repartition(3)) == brute(ODD)


def test_alignment_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = alignment.op11_alignment(spark, SF).collect()
    assert sorted((tuple(r[c] for c in names) for r in found), key=str) == brute(rows)


@pytest.mark.parametrize(("a", "b", "groups"), [([1, 2, 3], [3, 3], [[0, 0, 1], [0, 1]]), ([2, 2], [1, 2, 1], [[0, 0], [0, 0, 0]]), ([4], [1, 1, 2], [[0], [0, 0, 0]])])
def test_coalesced(a, b, groups):
    assert [x.tolist() for x in alignment.coalesced(alignment.np.array(a), alignment.np.array(b))] == groups
