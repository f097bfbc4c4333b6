import random
import re
import zlib
from collections import Counter

from chronomesh.llm import spelling
from chronomesh.llm.registry import queries


def counted(rows, least=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    """Every word with one letter less or another is asked for in a dictionary of gaps, which knows nothing of keys."""
    gaps, out = {}, {}
    for w in n:
        for g in {w[:i] + "\0" + w[i + 1 :] for i in range(len(w))} | {w[:i] + "\0" + w[i:] for i in range(len(w) + 1)}:
            gaps.setdefault(g, set()).add(w)
    near = {w: set() for w in n}
    for own in gaps.values():
        for a in own:
            near[a] |= {b for b in own if a != b and one_apart(a, b)}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(counted(docs))
    assert got(queries()["op12_spelling_variants"](spark, sf)) == want and any(x[0] for x in want.values())


def test_odd_words(spark):
    rng, rows = random.Random(3), [(None, None), (1, ""), (1, "12 一"), (None, "ÀÀÀÀÀ ààààà ×÷×÷×"), (7, "a" * 3_000 + " " + "a" * 2_999 + "b")]
    for i in range(400):
        size = rng.randint(4, 8)
        rows.append((i % 50, " ".join("".join(rng.choice("abBé") for _ in range(size)) for _ in range(20)) + "\U0001f600"))
    rows += rows[:200]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows * 2], "doc_id long, text string, n int, word string")
    want = brute(counted(rows * 2))
    assert got(spelling.variants(spelling.words(df))) == want
    assert sum(x[3] for x in want.values()) > 1_000 and any(x[0] and x[0] != x[1] for x in want.values())
    assert spelling.variants(spelling.words(df.limit(0))).count() == 0


def test_long_chains_and_hubs(spark):
    """Each word is a letter longer and twice as frequent; and one word has hundreds of variants."""
    chain = {"q" * 5 + "z" * k: 3 * 2**k for k in range(12)}
    hub = {w: 3 for w in {"hubword"[:i] + c + "hubword"[i + skip :] for i in range(8) for c in "abcdefghijklmnopqrstuvwxyé" for skip in (0, 1)} - {"hubword"}}
    n = chain | hub | {"hubword": 50}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    found = got(spelling.variants(df))
    assert found == brute(n) and found["qqqqq"][1] == max(chain, key=chain.get) and found["hubword"][3] == len(hub)
