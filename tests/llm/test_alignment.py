"""Alignment of two tokenizers against the libraries and plain loops."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest

from logweave.llm.alignment import _byte_alphabet, align_tokenizers
from logweave.llm.queries import QUERIES

from .helpers import edge_docs, empty_docs

ODD = ["  two  blanks ", " \n x", "a \n  b\t c ", "x▁y", "é İ ﬁ́   　z", "it's <|endoftext|> </s> <0x41>", "\x00\x85 \x85 q", "日本 語🙂"]


def brute(rows):
    """Rows as ``align_tokenizers`` returns them, of (id, text)."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    alphabet = _byte_alphabet()
    found, counts = [], Counter()
    for name, text in rows:
        raw = (" " + (text or "")).encode()
        a = first.encode(raw.decode(), add_special_tokens=False).ids
        b = second.encode(text or "")
        a_bytes = [bytes(alphabet[c] for c in first.id_to_token(k)) for k in a]
        b_bytes = [bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode() for k in b]
        links, groups = [], []
        if text and b"".join(a_bytes) == raw == b"".join(b_bytes):
            i = j = x = y = 0
            group = ([], [])
            while i < len(a):
                links.append((a[i], b[j]))
                ends = x + len(a_bytes[i]), y + len(b_bytes[j])
                if ends[0] <= ends[1]:
                    group[0].append(a[i])
                    i, x = i + 1, ends[0]
                if ends[1] <= ends[0]:
                    group[1].append(b[j])
                    j, y = j + 1, ends[1]
                if x == y:
                    groups.append(group)
                    group = ([], [])
        counts.update(links)
        found.append((name, a if links else [], b if links else [], groups, links))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    out = []
    for name, a, b, groups, links in found:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((name, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if links else ""))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("hot", [1_000_000, 40, 0])
def test_edges_and_any_number_of_hot_pairs(spark, hot):
    docs = edge_docs(spark).union(spark.createDataFrame([(100 + k, t, "en", 0.5, 7, "x") for k, t in enumerate(ODD)], "doc_id bigint, text string, lang string, score double, label int, digest string"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert any(w[3] < w[1] and w[3] < w[2] for w in want) and any(w[5] < w[4] for w in want)
    assert ordered(align_tokenizers(docs, hot_pairs=hot).collect()) == ordered(want)


def test_empty_table(spark):
    assert align_tokenizers(empty_docs(spark)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert ordered(QUERIES["op11_alignment"](spark, sf_dir).collect()) == ordered(brute([(r.doc_id, r.text) for r in docs]))
