import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from chronomesh.llm import alignment
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CELLS = {chr(b): b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
CELLS |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in CELLS)}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_tokens(text, libraries):
    """(id, start, end) of A and of B by the libraries alone; None without tokens."""
    a, b = libraries
    raw, out = (" " + (text or "")).encode(), []
    coded_a, coded_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
    spelled = [[bytes(CELLS[c] for c in a.id_to_token(i)) for i in coded_a]]
    spelled.append([bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in coded_b])
    if not text or any(b"".join(s) != raw for s in spelled):
        return None
    for ids, data in zip((coded_a, coded_b), spelled, strict=True):
        at, own = 0, []
        for i, d in zip(ids, data, strict=True):
            own.append((i, at, at + len(d)))
            at += len(d)
        out.append(own)
    return out


def brute(texts, libraries):
    found, holds, links = [plain_tokens(t, libraries) for t in texts], Counter(), []
    for tokens in found:
        own = []
        if tokens:
            over = [n for n, (_, u, v) in enumerate(tokens[1]) for _ in range(u, v)]  # the B token of each byte
            own = [(i, tokens[1][n][0]) for i, s, e in tokens[0] for n in sorted(set(over[s:e]))]
        links.append(own)
        holds.update(set(own))
    most = defaultdict(int)
    for (i, _), n in holds.items():
        most[i] = max(most[i], n)
    out = []
    for tokens, own in zip(found, links, strict=True):
        if not tokens:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for _, _, e in tokens[0]} & {e for _, _, e in tokens[1]})
        said, at = [], [0, 0]
        for end in ends:
            both = []
            for side in (0, 1):
                own_side = []
                while at[side] < len(tokens[side]) and tokens[side][at[side]][2] <= end:
                    own_side.append(str(tokens[side][at[side]][0]))
                    at[side] += 1
                both.append(",".join(own_side))
            said.append("|".join(both))
        out.append((len(tokens[0]), len(tokens[1]), len(ends), len(own), sum(holds[x] == most[x[0]] for x in own), sum(holds[x] for x in own), hashlib.sha256(";".join(said).encode()).hexdigest()))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(spark, texts, libraries, **more):
    df = spark.createDataFrame([(i, t, "x", [1], 3) for i, t in enumerate(texts)], "doc_id int, text string, n_a string, pairs array<int>, row long")
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in alignment.align(df, A, B, **more).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, libraries)
    assert alignment.align(df.limit(0), A, B).count() == 0


def odd_texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "the ", " ", "  ", "\n", " \n", "é", "日本", "😀", "\x00", "　", "'s", " 's", "12", "<s>", "</s>", "<|endoftext|>", "\x1c", "ing", "-", "\xa0"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return [None, "", " ", "a", "a ", " a", "  a  b \n c", "has ▁ sign", "<0x41>", "don't stop", "é" * 300, "x" * 5_000, "tie tie tie", "tie tie tie", *made]


def test_equals_libraries_and_loops(spark, libraries):
    check(spark, odd_texts(), libraries)


def test_counts_that_are_not_broadcast(spark, libraries):
    check(spark, odd_texts()[:60], libraries, most_broadcast=0)


def test_given_documents(spark, libraries):
    from chronomesh.llm.registry import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in queries()["op13_token_alignment"](spark, sf).collect()}
    assert [got[d.doc_id] for d in docs] == brute([d.text for d in docs], libraries)


def test_pieces_equal_the_library(libraries):
    known = alignment.Pieces(B)
    assert known.fast is not None
    for t in odd_texts():
        assert not t or "▁" in t or known.encode(t).tolist() == libraries[1].encode(t)
