"""SentencePiece encoding and decoding of texts of any length.

A text is a lattice whose nodes are the vocabulary's occurrences (and every
single character).  Its encoding is the best path, in the max-plus sense: the
weight of a path is the sum of its pieces' weights, minus infinity where two
neighbours can't stand together.  A BPE model's result is the one path whose
neighbours all are what BPE makes of the two of them together, so weights are zero
or minus infinity.  Unigram models, which weigh by scores, are refused, as are
vocabularies over 65,536 pieces.

A giant text is cut into chunks.  The state at a cut is the node that covers or
touches it from the left, so the states at a cut follow from the few characters
around it.  Each chunk yields the transfer matrix of best weights between its
entry and exit states, with no knowledge of the others.  The matrices are
combined associatively (prefix and suffix products), which settles the state at
every cut, and then each chunk is backtraced alone.

Inside a chunk the lattice falls apart at word edges (no piece has a blank after
another character), where the state is unique.  Only the parts between a cut and
the next word edge need the lattice; words between are looked up among the words
met before, ``MAX_WORDS_HELD`` at most, which the library fills.

Defined results: a null or empty text has no ids; repeated rows each get theirs;
decoding gives the text back, but for U+2581, which the model reads as a blank.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written

CHUNK_CHARS = 1 << 16
MAX_WORDS_HELD = 500_000
_BLANK = "▁"
_NO = -np.inf
_EDGE = re.compile(f"(?<=[^{_BLANK}])(?={_BLANK})")
_WORD = re.compile(f"{_BLANK}+[^{_BLANK}]*|^[^{_BLANK}]+")


class Codec:
    """A SentencePiece BPE model with identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.encode("Å Á  x", out_type=str)[0][:1] != _BLANK or sp.decode(sp.encode("ÅÅ  ﬁ ")) != "ÅÅ  ﬁ ":
            raise ValueError("this model normalises texts; only identity normalisation is handled")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): (sp.get_score(i), i) for i in plain}
        if any(_BLANK in p.lstrip(_BLANK) for p in self.rank):
            raise ValueError("a piece has a blank after another character")
        if n > 1 << 16:
            raise ValueError("ids of more than 65,536 pieces don't fit into 16 bits")
        if any(score != int(score) for score, _ in self.rank.values()):
            raise ValueError("scores that are not ranks: a unigram model; only BPE models are handled")
        self.longest = max(map(len, self.rank))
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.surface = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(_BLANK, " ").encode() for i in range(n)]
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.unk = sp.unk_id()

    # -- the whole of a text between word edges

    @staticmethod
    def normal(text: str) -> str:
        return _BLANK + text.replace(" ", _BLANK) if text else ""

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.rank:
            return [self.rank[piece][1]]
        return [self.byte_ids.get(b, self.unk) for b in piece.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unk]

    def by_words(self, text: str) -> bytes:
        """Ids (16-bit) of a stretch that begins and ends at word edges."""
        if not text:
            return b""
        parts = [_BLANK + p for p in text.split(_BLANK)[1:]] if text[0] == _BLANK and _BLANK * 2 not in text else _WORD.findall(text)
        held = self.words
        new = set(parts).difference(held)
        if new:
            if len(held) + len(new) > MAX_WORDS_HELD:
                held.clear()
                new = set(parts)
            new = [*new]
            for w, ids in zip(new, self.sp.encode([w[1:].replace(_BLANK, " ") for w in new], num_threads=1), strict=True):
                held[w] = array("H", ids or self.piece_ids(w)).tobytes()
        return b"".join(map(held.__getitem__, parts))

    def decode(self, ids: np.ndarray, first: bool = True) -> str:
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if first and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")

    # -- the lattice between a cut and a word edge

    def _bpe(self, text: str) -> list[str]:
        s = [*text]
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                got = self.rank.get(s[i] + s[i + 1])
                if got and (best is None or got[0] > best):
                    best, at = got[0], i
            if at < 0:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def stand(self, a: str, b: str) -> bool:
        """Whether the pieces can be neighbours."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > MAX_WORDS_HELD:
                self.pairs.clear()
            got = self.pairs[a, b] = self._bpe(a + b) == [a, b]
        return got

    def nodes_from(self, text: str, s: int) -> Iterator[int]:
        """Ends of the pieces that start at ``s``."""
        yield s + 1
        for e in range(s + 2, min(s + self.longest, len(text)) + 1):
            if text[s:e] in self.rank:
                yield e

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Nodes (start, end) with start < cut <= end that BPE can make alone."""
        return [(s, e) for s in range(max(0, cut - self.longest), cut) for e in self.nodes_from(text, s) if e >= cut and self._bpe(text[s:e]) == [text[s:e]]]

    def spread(self, text: str, start: dict[tuple[int, int], np.ndarray], stop: int, keep_back: bool = False):
        """Max-plus weights of all nodes reached from the ``start`` nodes, up to
        nodes that reach ``stop``; ``keep_back`` keeps best predecessors."""
        weight, back = dict(start), {}
        at: dict[int, list] = {}
        for n in start:
            at.setdefault(n[1], []).append(n)
        for p in range(min(at, default=stop), stop):
            before = at.get(p)
            if not before:
                continue
            for e in self.nodes_from(text, p):
                piece = text[p:e]
                ok = [b for b in before if self.stand(text[b[0] : b[1]], piece)]
                if not ok:
                    continue
                node, value = (p, e), np.max([weight[b] for b in ok], axis=0)
                if node in weight:
                    value = np.maximum(value, weight[node])
                weight[node] = value
                if keep_back:
                    back[node] = max(ok, key=lambda b: weight[b].max())
                at.setdefault(e, []).append(node)
        return weight, back


class Chunk:
    """``text`` of a giant normalised text from ``left`` to ``right`` with
    ``margin`` characters of context on both sides."""

    def __init__(self, codec: Codec, text: str, left: int, right: int, first: bool, last: bool):
        self.c, self.text, self.left, self.right = codec, text, left, right
        self.first, self.last = first, last
        edges = [left] if first else []
        m = _EDGE.search(text, max(left, 1), right + 1)
        if m and not first:
            edges.append(m.start())
        self.head = edges[0] if edges else None  # first word edge at or after the left cut
        self.tail = None
        if last:
            self.tail = right
        else:
            i = right
            while i >= left and self.tail is None:
                i = text.rfind(_BLANK, left, i + 1)
                if i < 0:
                    break
                if i == 0 or text[i - 1] != _BLANK:
                    if i > 0 or first:
                        self.tail = i
                    break
                i -= 1
        if self.head is not None and (self.tail is None or self.tail < self.head):
            self.tail = self.head
        if self.head is None:
            self.tail = None

    def entry(self) -> list[tuple[int, int]]:
        return [(-1, self.left)] if self.first else self.c.states(self.text, self.left)

    def exit(self) -> list[tuple[int, int]]:
        return [(-1, self.right)] if self.last else self.c.states(self.text, self.right)

    def matrix(self) -> np.ndarray:
        """Best weights from entry states (rows) to exit states (columns)."""
        rows, cols = self.entry(), self.exit()
        if self.head is None and not self.last:
            return self._through(rows, cols)
        if self.head is None:  # the last chunk, without a word edge
            weight, _ = self.c.spread(self.text, self._identity(rows), self.right)
            ends = [w for n, w in weight.items() if n[1] == self.right]
            return (np.max(ends, axis=0) if ends else np.full(len(rows), _NO))[:, None]
        enter = np.zeros(1) if self.first else self._to_edge(rows)
        leave = np.zeros(1) if self.last else self._from_edge(cols)
        return enter[:, None] + leave[None, :]

    def _identity(self, rows):
        eye = np.where(np.eye(len(rows), dtype=bool), 0.0, _NO)
        return {n: eye[k] for k, n in enumerate(rows)}

    def _through(self, rows, cols):
        if self.first:
            weight, _ = self.c.spread(self.text, self._seed(self.left), self.right)
        else:
            weight, _ = self.c.spread(self.text, self._identity(rows), self.right)
        return np.stack([weight.get(n, np.full(len(rows), _NO)) for n in cols], axis=1)

    def _to_edge(self, rows):
        weight, _ = self.c.spread(self.text, self._identity(rows), self.head)
        ends = [w for n, w in weight.items() if n[1] == self.head]
        return np.max(ends, axis=0) if ends else np.full(len(rows), _NO)

    def _seed(self, at: int):
        return {(at, e): np.zeros(1) for e in self.c.nodes_from(self.text, at)}

    def _from_edge(self, cols):
        if self.tail == self.right:  # the cut is a word edge itself: every state ending there
            return np.array([0.0 if e == self.right else _NO for _, e in cols])
        weight, _ = self.c.spread(self.text, self._seed(self.tail), self.right)
        return np.array([weight[n][0] if n in weight else _NO for n in cols])

    def backtrace(self, enter: tuple[int, int], leave: tuple[int, int]) -> bytes:
        """Ids of the nodes that start in this chunk, given the states at its cuts."""
        c, text, out = self.c, self.text, []

        def path(start, stop, goal):
            weight, back = c.spread(text, start, stop, keep_back=True)
            ends = [goal] if goal else [n for n in weight if n[1] == stop]
            node, nodes = max(ends, key=lambda n: weight[n].max()), []
            while node is not None:
                nodes.append(node)
                node = back.get(node) if node not in start else None
            return nodes[::-1]

        def ids(nodes):
            return array("H", [i for s, e in nodes if self.left <= s < self.right for i in c.piece_ids(text[s:e])]).tobytes()

        goal = None if self.last else leave
        if self.head is None:
            start = self._seed(self.left) if self.first else {enter: np.zeros(1)}
            nodes = path(start, self.right, goal) if goal not in start else [goal]
            return ids([n for n in nodes if n != enter])
        if not self.first:
            out.append(ids([n for n in path({enter: np.zeros(1)}, self.head, None) if n != enter]))
        if self.last or self.tail == self.right:
            out.append(c.by_words(text[self.head : self.right]))
        else:
            out.append(c.by_words(text[self.head : self.tail]))
            out.append(ids(path(self._seed(self.tail), self.right, goal)))
        return b"".join(out)


def cut_points(text: str, size: int) -> list[int]:
    """Cuts of a normalised text, ``size`` characters apart but never inside or
    right after a run of several blanks (such a cut moves to the run's start)."""
    cuts, at = [0], size
    while at < len(text):
        cut = at
        start = text.rfind(_BLANK, max(cuts[-1], cut - 64), cut + 1)
        if start >= 0 and (start == cut or text[start - 1] == _BLANK) and start > 0:
            while start > cuts[-1] and text[start - 1] == _BLANK:
                start -= 1
            cut = start
        if cut > cuts[-1]:
            cuts.append(cut)
        at = max(at, cut) + size
    return [*cuts, len(text)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by a balanced recursion (Blelloch's scan)."""
    if len(matrices) == 1:
        return matrices
    pairs = scan([product(*matrices[i : i + 2]) for i in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(pairs[i // 2] if i % 2 else product(pairs[i // 2 - 1], matrices[i]))
    return out


def settle(matrices: list[np.ndarray]) -> list[int]:
    """The best path's state at every inner cut."""
    forward = scan(matrices)
    backward = [m.T for m in scan([m.T for m in matrices[::-1]])][::-1]
    return [int(np.argmax(f[0, :] + b[:, 0])) for f, b in zip(forward[:-1], backward[1:], strict=True)]


def _slices(batches: Iterator[pa.RecordBatch], n: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in runs of ``n`` rows, so that results stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)


def _lists(ids: list[bytes]) -> pa.ListArray:
    """16-bit ids of each row as one list column."""
    offsets = np.concatenate(([0], np.cumsum([len(x) // 2 for x in ids], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u2").astype(np.int32)))


_HELD = None


def codec(path: str) -> Codec:
    global _HELD
    if _HELD is None or _HELD[0] != path:
        _HELD = (path, Codec(path))
    return _HELD[1]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``id_col``, ``carry`` columns and ids (array<int>)."""
    kept = [F.col(id_col).alias("id"), F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.struct(F.lit(1).alias("_")).alias("carried")]
    d = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type, carried = d.schema["id"].dataType.simpleString(), d.schema["carried"].dataType.simpleString()
    long = F.length("text") > chunk_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in _slices(batches):
            at = batch.schema.get_field_index("text")
            ids = [c.by_words(c.normal(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("carried"), _lists(ids)], ["id", "carried", "ids"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_path)
        m = c.longest + 1
        for pdf in batches:
            for row, text in zip(pdf["row"], pdf["text"], strict=True):
                t = c.normal(text)
                cuts = cut_points(t, chunk_chars)
                for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    lo, hi = max(0, a - m), min(len(t), z + m)
                    yield pd.DataFrame({"row": [row], "k": [k], "n": [len(cuts) - 1], "lo": [a - lo], "hi": [z - lo], "chunk": [t[lo:hi]]})

    def chunk(c, r) -> Chunk:
        return Chunk(c, r.chunk, int(r.lo), int(r.hi), r.k == 0, r.k == r.n - 1)

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_path)
        for pdf in batches:
            made = [chunk(c, r).matrix() for r in pdf.itertuples()]
            yield pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "height": [m.shape[0] for m in made], "matrix": [m.ravel() for m in made]})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        found = settle([np.asarray(m).reshape(h, -1) for m, h in zip(pdf["matrix"], pdf["height"], strict=True)])
        return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "enter": [0, *found], "leave": [*found, 0]})

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_path)
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x = chunk(c, r)
                out.append(np.frombuffer(x.backtrace(x.entry()[r.enter], x.exit()[r.leave]), "<u2").astype("<i4"))
            yield pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "ids": out})

    short = d.where(~long).mapInArrow(whole, f"id {id_type}, carried {carried}, ids array<int>")
    # giants get a name of their own, written with them, so that repeated rows stay apart
    giants = written(d.where(long).withColumn("row", F.monotonically_increasing_id()))
    cuts = written(giants.select("row", "text").mapInPandas(cut, "row long, k int, n int, lo int, hi int, chunk string").repartition("row", "k"))
    matrices = cuts.mapInPandas(transfer, "row long, k int, height int, matrix array<double>")
    states = matrices.groupBy("row").applyInPandas(combine, "row long, k int, enter int, leave int")
    traced = cuts.join(states, ["row", "k"]).mapInPandas(trace, "row long, k int, ids array<int>")
    joined = traced.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    out = short.unionByName(giants.select("row", "id", "carried").join(joined, "row").select("id", "carried", "ids"))
    return out.select(F.col("id").alias(id_col), *[F.col(f"carried.`{c}`") for c in carry], "ids")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the decoded text beside its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in _slices(batches):
            at = batch.schema.get_field_index(ids_col)
            texts = [c.decode(x.values.to_numpy()) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != text_col)
    return encoded.select(*[f.name for f in encoded.schema if f.name != text_col]).mapInArrow(run, f"{names}, {text_col} string")
