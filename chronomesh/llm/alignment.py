"""Cross-tokenizer alignment: which tokens of two encodings of one text cover the same bytes.

A is a byte-level BPE file of the tokenizers library and reads a space and the text; B is a
sentencepiece model and reads the text, to which it adds that space. The B tokens of a text are an
interval index: their ends, in order. For each A token two bisections list the B tokens it
overlaps, its links. Gaps between B tokens that no A token spans are the bounds of groups.

Spark then counts in how many rows each linked pair of ids occurs, finds the highest count of each
A id, and joins both back. Counts go by broadcast only while there are MOST_BROADCAST pairs at most;
beyond that both sides are shuffled by pair, and adaptive joins split frequent pairs.

Null and empty texts, and texts whose tokens don't spell a space and the text (those that hold
U+2581, the model's sign for a space), have no tokens: zeros, and an empty digest. Repeated rows
count as documents of their own. An empty table gives an empty result. Further columns are ignored,
whatever their names. A text is aligned in one piece, which needs about 100 bytes for each of its
tokens.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import encoder
from .common import map_arrow, settle, small_batches, table

SPACE = "▁"
#: Pairs whose counts may be broadcast.
MOST_BROADCAST = 1_000_000


class Pieces:
    """Ids of a sentencepiece BPE model, run by tiktoken, which is faster: merges of a character's bytes come first, then those
    of pieces by their score. Models that are more than merges inside words go to their own library."""

    def __init__(self, path: str):
        import sentencepiece
        import tiktoken

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(len(model))]
        byte = {int(p[3:5], 16): i for i, p in enumerate(names) if model.is_byte(i)}
        normal = [i for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.data = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        in_words = all(not (x != SPACE and y == SPACE) for i in normal for x, y in zip(names[i], names[i][1:], strict=False))
        probe = "  a  b\t\u00a0\uff21 c "
        lossless = b"".join(self.data[i] for i in model.encode(probe)) == (" " + probe).encode()
        self.fast = None
        normal = [i for i in normal if 2 * SPACE not in names[i]]  # runs of spaces may have equal scores; texts with such runs go to the library
        if len(byte) == 256 and in_words and lossless and len({model.get_score(i) for i in normal}) == len(normal):
            ranks = {bytes([b]): b for b in range(256)}
            for c in {c for i in normal for c in names[i].replace(SPACE, " ")}:
                raw = c.encode()
                for end in range(2, len(raw) + 1):
                    ranks.setdefault(raw[:end], len(ranks))
            for i in sorted(normal, key=model.get_score, reverse=True):
                ranks.setdefault(self.data[i], len(ranks))
            own = {self.data[i]: i for i in normal}
            self.fast = tiktoken.Encoding("pieces", pat_str=r" *[^ ]+| +", mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.ids = np.full(len(ranks), -1, np.int64)  # of what is one piece
            self.rest = {}
            for raw, rank in ranks.items():
                if raw in own:
                    self.ids[rank] = own[raw]
                else:
                    self.rest[rank] = [byte[b] for b in raw]
                    if len(raw) == 1:
                        self.ids[rank] = byte[raw[0]]

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or "  " in text or text.startswith(" "):
            return np.array(self.model.encode(text), np.int64)
        ranks = buffer_of(self.fast, " " + text)
        ids = self.ids[ranks]
        if len(odd := np.flatnonzero(ids < 0)):  # some bytes of a character that is no piece
            found = ids.tolist()
            for i in odd.tolist():
                found[i] = self.rest[int(ranks[i])]
            ids = np.array([x for y in found for x in (y if isinstance(y, list) else (y,))], np.int64)
        return ids


def buffer_of(core, text: str) -> np.ndarray:
    return np.frombuffer(core.encode_to_tiktoken_buffer(text, set()), "<u4").astype(np.int64)


class Both:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoder(path_a), Pieces(path_b)
        n_a, n_b = max(self.a.data, default=0) + 1, len(self.b.data)
        self.size_b, self.data_a, self.data_b = n_b, [self.a.data.get(i, b"") for i in range(n_a)], self.b.data
        self.length_a, self.length_b = (np.array([len(x) for x in d], np.int64) for d in (self.data_a, self.data_b))
        written = [[f"{i},".encode(), f"{i}{last}".encode()] for last, n in (("|", n_a), (";", n_b)) for i in range(n)]
        self.written = np.array(list(chain.from_iterable(written)), object)  # an id inside a group, and at its end

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B; None for a text that has no tokens."""
        if not text or SPACE in text:
            return None
        a, b = np.frombuffer(self.a.encode(" " + text, plain=True), "<u4").astype(np.int64), self.b.encode(text)
        raw = (" " + text).encode()
        spelled = lambda ids, data: b"".join(map(data.__getitem__, ids.tolist())) == raw
        return (a, b) if spelled(a, self.data_a) and spelled(b, self.data_b) else None


@lru_cache(maxsize=2)
def both(path_a: str, path_b: str) -> Both:
    return Both(path_a, path_b)


def overlaps(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First B token that each A token overlaps, and the one after the last; both lists tile the same bytes."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    return np.searchsorted(end_b, end_a - length_a, "right"), np.searchsorted(end_b - length_b, end_a, "left")


def groups(low: np.ndarray, high: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A and of each B token: bounds are the gaps between B tokens that no A token spans."""
    spanned = np.cumsum(np.bincount(low, minlength=n_b) - np.bincount(high - 1, minlength=n_b))
    opens = np.concatenate([[False], spanned[: n_b - 1] == 0])
    of_b = np.cumsum(opens)
    return of_b[low], of_b


def written_groups(known: Both, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> bytes:
    """a1,a2|b1;a3|b2,b3: the groups' A and B ids in order."""
    last_a, last_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.searchsorted(of_b, of_a, "left")] = 2 * a + last_a
    codes[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = 2 * (len(known.data_a) + b) + last_b
    return b"".join(known.written[codes].tolist())[:-1]


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a row's linked id pairs in order, as A id times
    B's vocabulary plus B id, and how often each is linked."""
    small_batches(docs.sparkSession)
    none = np.zeros(0, np.int64)

    def row(text):
        known = both(path_a, path_b)
        found = known.tokens(text)
        if found is None:
            return 0, 0, 0, 0, "", none, none
        a, b = found
        low, high = overlaps(known.length_a[a], known.length_b[b])
        of_a, of_b = groups(low, high, len(b))
        count = high - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        pairs, times = np.unique(np.repeat(a, count) * known.size_b + b[at], return_counts=True)
        digest = hashlib.sha256(written_groups(known, a, b, of_a, of_b)).hexdigest()
        return len(a), len(b), int(of_b[-1]) + 1, len(at), digest, pairs, times

    def run(batches):
        for batch in batches:
            *numbers, digest, pairs, times = zip(*map(row, batch.column(1).to_pylist()), strict=True)
            edges = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x), kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in numbers), pa.array(digest, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, schema)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many rows a pair is linked, and whether that is the most of its A id. An A id has size_b pairs at most."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair div {size_b}")))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    import sentencepiece

    size_b = len(sentencepiece.SentencePieceProcessor(model_file=path_b))
    rows = settle(aligned(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = settle(pair_counts(rows, size_b))
    if counts.count() <= most_broadcast:
        counts = F.broadcast(counts)
    linked = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    sums = linked.join(counts, "pair").groupBy("row").agg(best.alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", number("n_best"), number("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level BPE file and the sentencepiece model over all documents."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
