"""Packing: deficit round-robin over source queues fills every window to target token proportions.

Each source is a queue of its documents' tokens. In every window each queue's deficit grows by its share of the window;
the queue with the largest deficit is served first, for its deficit but at least BURST tokens, and what it was served
too much or too little is carried into the next window. A cycle of CYCLE windows ends with every deficit at zero, so
a cycle is worked out once (on the driver: its size depends on the number of sources alone) and repeated: any task can
tell from a queue position alone which window and offset it falls on. Deficits are so carried across windows and
partitions without a sequential pass over the data. When a queue cannot fill another cycle, cycles are halved down to a single
window; when it runs dry, the other queues share its part. Less than one window at the end becomes sequences whose
lengths are powers of two, which need no padding; all other sequences are full.

A cycle's plan needs a row for each queue: beyond QUEUES sources, the smallest ones share a queue.

Steps: tokenise once into a table in the shared folder (each task knows how far its own rows reach in each queue); add
up partitions x sources, the only thing that is ordered; cut every document at the windows' edges.

Nulls, ties, empties: null text is empty and packs as its end id; a null source is a queue of its own; repeated rows and ids are
packed each; an empty table gives no rows; other columns are ignored. A document of any length is cut as often as needed.
"""

from __future__ import annotations

import bisect
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.shared import stored, text_or_empty

WINDOW, BURST, CYCLE = 2048, 256, 256
#: Sources with a queue of their own, those with most tokens (and all that targets name); the others share one queue, in which each has its part. What
#: the driver plans and broadcasts is bounded by it, however many sources there are.
QUEUES = 4096
#: Words that a worker remembers twice over (about 50 MB a generation), and the longest one worth remembering.
REMEMBERED, LONGEST = 240_000, 64
#: What a byte-level BPE splits texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Whether this machine's numbers must be turned round to be little-endian.
SWAPPED = sys.byteorder == "big"
#: Marks that may end a word as a piece of their own.
ENDS = frozenset(".,;:!?)]}\"")


class Pieces(dict):
    """Token ids of what the byte-level pattern splits a text into."""

    def __init__(self, encode: Callable[[bytes], list[int]], code: str):
        self.encode, self.code = encode, code

    def ids(self, piece: str) -> bytes:
        out = array(self.code, self.encode(piece.encode()))
        if SWAPPED:
            out.byteswap()
        return out.tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self.ids(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED // 8:
                self.clear()
            self[piece] = out
        return out


class Encoder(dict):
    """Token ids of texts, by a `tokenizers` file; remembers the ids of chunks between single spaces.

    A byte-level BPE never joins what stands before a space with what stands after it, so chunks with their leading
    space have the same ids alone as in the text, unless white space stands in a row, which is left to the tokenizer
    itself. Chunks are merged by the file's own vocabulary; whether that gives what the tokenizer gives is tried out when
    the file is loaded, and the tests compare both on odd texts. Files of other kinds are left to the tokenizer.
    """

    PROBE = "A b, c.\nDé f 12x'll\n\ng\tñ thinking <|endoftext|> Überraschung internationalisation"

    def __init__(self, path: str, end_id: int | None):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.code = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.end = np.array([] if end_id is None else [end_id], self.code).tobytes()
        self.uneven = regex.compile(r"\s ")
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves; the others follow from 256 on
        others = [b for b in range(256) if b not in kept]
        signs = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}
        # the file's own vocabulary, as ranks: a byte-level BPE numbers its tokens in the order of its merges
        ranks = {bytes(map(signs.get, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in signs for c in t)}
        merge = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece if all(bytes([b]) in ranks for b in range(256)) else None
        self.pieces = Pieces(merge, "H" if self.code == "<u2" else "I")
        self.words = regex.compile(PATTERN)
        self.by_chunk = merge is not None
        self.by_chunk = self.one(self.PROBE) == self.plain(self.PROBE)

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.code).tobytes()

    def __missing__(self, word: str) -> bytes:
        """Ids of a word after a space. Two generations are remembered, so that frequent words outlast rare ones."""
        ids = self.older.get(word)
        if ids is None:
            ids = self.pieces.ids(" " + word) if self.by_chunk and word.isalpha() else self.encoded(" " + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encoded(self, chunk: str) -> bytes:
        if not self.by_chunk:
            return self.plain(chunk)
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return self.pieces.ids(chunk)
        if word[:-1].isalpha() and word[-1] in ENDS:
            return self.pieces.ids(chunk[:-1]) + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, self.words.findall(chunk)))

    def one(self, text: str) -> bytes:
        if not self.by_chunk or self.uneven.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return b"".join([self.encoded(first), *map(self.__getitem__, rest)])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def tokenised(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """doc_id, source, part, at (tokens of the source before it in the part), n, ids (little-endian, 2 or 4 bytes each)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, reached = encoder(path, end_id), TaskContext.get().partitionId(), {}
        width = int(known.code[-1])
        for batch in batches:
            for i in range(0, len(batch), 500):
                rows = batch.slice(i, 500)
                ids = [known.one(t) + known.end for t in rows["text"].to_pylist()]
                sources, n, at = rows["source"].to_pylist(), [len(x) // width for x in ids], []
                for s, k in zip(sources, n, strict=True):
                    at.append(reached.get(s, 0))
                    reached[s] = at[-1] + k
                yield pa.record_batch([rows["doc_id"], rows["source"], pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "part", "at", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    return rows.mapInArrow(encode, "doc_id long, source string, part int, at long, n long, ids binary")


class Schedule:
    """Which window and offset each queue position falls on."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, window: int = WINDOW, burst: int = BURST, cycle: int = CYCLE):
        self.names = sorted(s for s, n in totals.items() if n)
        self.left = np.array([totals[s] for s in self.names], np.int64)
        self.done = np.zeros(len(self.names), np.int64)
        self.weights = self.left.astype(float) if targets is None else np.array([float(targets.get(s, 0)) for s in self.names])
        self.deficit = np.zeros(len(self.names))
        self.windows = 0
        #: For each source its phases: queue position, first window, windows in a cycle, tokens in a cycle, and a cycle's
        #: segments as queue positions, windows and offsets.
        self.phases: dict[str, list[tuple]] = {s: [] for s in self.names}
        self.lengths = (0, ())  # full windows, then the lengths of the last sequences
        self._run(window, burst, cycle)
        self.starts = {s: [p[0] for p in phases] for s, phases in self.phases.items()}

    def _shares(self, most: int) -> np.ndarray:
        """Tokens for each queue that has any left, `most` in all, by weight: largest remainders."""
        w = np.where(self.left > 0, self.weights, 0.0)
        if not w.sum():
            w = np.where(self.left > 0, self.left, 0).astype(float)
        exact = most * w / w.sum()
        out = np.floor(exact).astype(np.int64)
        for s in np.argsort(out - exact, kind="stable")[: most - out.sum()]:
            out[s] += 1
        return out

    def _fill(self, left: np.ndarray, quantum: np.ndarray, need: int, burst: int) -> list[tuple[int, int, int]]:
        """One window: (source, offset, tokens) as served; left and the deficits change."""
        self.deficit += quantum
        served, offset = [], 0
        while need:
            s = int(np.argmax(np.where(left > 0, self.deficit, -np.inf)))
            n = int(min(left[s], need, max(burst, int(self.deficit[s]))))
            served.append((s, offset, n))
            left[s] -= n
            self.deficit[s] -= n
            offset, need = offset + n, need - n
        return served

    def _keep(self, segments: list[list[tuple[int, int, int]]], repeats: int) -> None:
        own: dict[int, tuple[list, list, list]] = {}
        used = np.zeros(len(self.names), np.int64)
        for w, served in enumerate(segments):
            for s, offset, n in served:
                for to, x in zip(own.setdefault(s, ([], [], [])), (int(used[s]), w, offset), strict=True):
                    to.append(x)
                used[s] += n
        for s, lists in own.items():
            self.phases[self.names[s]].append((int(self.done[s]), self.windows, len(segments), int(used[s]), *lists))
        self.done += repeats * used
        self.left -= repeats * used
        self.windows += repeats * len(segments)

    def _run(self, window: int, burst: int, cycle: int) -> None:
        while (rest := int(self.left.sum())) >= window:
            n, size = 0, cycle
            while size:
                shares = self._shares(window * size)
                n = min((int(b // g) for b, g in zip(self.left, shares, strict=True) if g), default=0)
                if n:
                    break
                size //= 2
            if n:
                self.deficit[:] = 0
                allotted = shares.copy()
                self._keep([self._fill(allotted, shares / size, window, burst) for _ in range(size)], n)
            else:  # a queue runs dry within the next window
                self._keep([self._fill(self.left.copy(), self._shares(window).astype(float), window, burst)], 1)
        full, last = self.windows, []
        while rest := int(self.left.sum()):
            last.append(1 << (rest.bit_length() - 1))
            self._keep([self._fill(self.left.copy(), self._shares(last[-1]).astype(float), last[-1], burst)], 1)
        self.lengths = (full, tuple(last))

    def pieces(self, source: str, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(from, tokens, sequence, offset) of the document at queue positions start .. start+n."""
        phases, starts = self.phases[source], self.starts[source]
        x, end = start, start + n
        k = bisect.bisect_right(starts, x) - 1
        while x < end:
            while k + 1 < len(starts) and starts[k + 1] <= x:
                k += 1
            base, first, size, total, at, windows, offsets = phases[k]
            turn, r = divmod(x - base, total)
            i = bisect.bisect_right(at, r) - 1
            stop = at[i + 1] if i + 1 < len(at) else total
            took = min(end - x, stop - r)
            yield x - start, took, first + turn * size + windows[i], offsets[i] + r - at[i]
            x += took


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 1, targets: dict[str, float] | None = None, window: int = WINDOW, burst: int = BURST, cycle: int = CYCLE) -> DataFrame:
    """One row per piece: doc_id, source, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    targets: a weight for each source, by default the tokens it has; a source without one comes last.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    tokens = stored(tokenised(docs, tokenizer, end_id), "pack-tokens", codec="zstd")
    parts = stored(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "pack-parts")
    sizes = parts.groupBy("source").agg(F.sum("n").alias("n"))
    named = F.col("source").isin(*targets) if targets else F.lit(False)
    own = sizes.orderBy(F.desc(named), F.desc("n"), "source").limit(QUEUES)
    totals = {f"own:{r['source']}": r["n"] for r in own.toLocalIterator()}  # QUEUES rows at most
    rest = (sizes.agg(F.sum("n")).first()[0] or 0) - sum(totals.values())
    if rest:
        totals["rest"] = rest
    queue = F.when(F.col("mine"), F.concat(F.lit("own:"), "source")).otherwise("rest")
    queued = parts.join(own.select("source", F.lit(True).alias("mine")), "source", "left").withColumn("queue", queue)
    before = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(queued.select("part", "source", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "pack-bases")
    weights = {f"own:{k}": v for k, v in targets.items()} if targets else None
    schedule = docs.sparkSession.sparkContext.broadcast(Schedule(totals, weights, window, burst, cycle))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = schedule.value
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("doc_id", "source", "queue", "n", "start")]
            out, size = [], 0
            for row, (doc, source, queue, n, start) in enumerate(zip(*columns, strict=True)):
                blob = batch["ids"][row].as_buffer()
                if not n:
                    continue
                ids = np.frombuffer(blob, f"<u{len(blob) // n}").astype("<u4").tobytes()  # bytes: Arrow keeps a hold of each memoryview that it is given
                for at, took, sequence, offset in plan.pieces(queue, start, n):
                    out.append((doc, source, at, took, n, sequence, offset, ids[4 * at : 4 * (at + took)]))
                size += len(ids)
                if size > 8 << 20:
                    yield made(out)
                    out, size = [], 0
            if out:
                yield made(out)

    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]
    names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    placed = tokens.join(bases, ["part", "source"]).select("doc_id", "source", "queue", "n", (F.col("at") + F.col("base")).alias("start"), "ids")
    return placed.mapInArrow(cut, ", ".join(f"`{n}` {'string' if n == 'source' else 'binary' if n == 'ids' else 'long'}" for n in names))
