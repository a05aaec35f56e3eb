"""Token counts by a compiled finite-state transducer and a parallel prefix scan.

*Transducer.*  Byte-level BPE behind a pre-tokenizer is one deterministic machine
over characters.  Two facts make it finite.  The tokens of a piece's prefix are
those of a shorter prefix and one token more, and two tokens stand side by side
exactly if BPE leaves them so; hence the last token of every prefix follows from the
last tokens of the prefixes at which a token may still be open.  So a state inside a
piece holds the open strings (each a proper prefix of some token), with the last
token before each and how many tokens fewer it has; the pre-tokenizer adds its class
and at most one undecided white space or two undecided letters of a contraction.  A
transition reads a character and is annotated with the number of tokens emitted,
which is negative where a longer token swallows shorter ones; a state's final
count stands for what is undecided.

The machine is compiled while it is used: a state's transition is made when it is
first taken.  Spelling it out for 50,000 merges would make millions of states that no
text reaches.  At most ``MAX_STATES`` are held; beyond it all are dropped and made
again, which never changes a count.

*State maps.*  Between a character that is no white space and a white space every
state goes on to the same one, without emitting.  A chunk's map is what it does to
the machine: the text before its first such position (``head``), the count between
the first and the last and the text after the last (``tail``).  The composition of
two neighbouring maps runs the machine over ``tail + head``; it is associative, so
the maps of a long text are made by different tasks and combined in a balanced tree.
A stretch without any such position is carried whole, as the row that holds it was.

Defined results: a null or empty text has no bytes and no tokens; repeated documents
each get a row; ids of any type come back unchanged; a special string inside a text
is one token and ends the pieces on both sides, as the library has it by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written
from netloom.llm.pieces import byte_alphabet

CHUNK_CHARS = 1 << 14
MAX_STATES = 200_000
MAX_PAIRS = 500_000
# The characters of Unicode's White_Space property.
_WS = " \t-\r\x85\xa0  -     　"
_SPACE = re.compile(f"[{_WS}]")
_SYNC = re.compile(f"(?<=[^{_WS}])(?=[{_WS}])")
# What may follow an apostrophe in a contraction.
_SHORT, _LONG = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}


class State(dict):
    """Transitions by character: (next state, tokens emitted).  ``key`` describes the
    state, so that it can be compiled anew; ``final`` is its final count."""

    __slots__ = ("key", "machine", "final")

    def __missing__(self, char: str):
        machine = self.machine
        key, emitted = machine.step(self.key, char)
        self[char] = got = (machine.state(key), emitted)
        return got


class CountTransducer:
    """Counts the tokens of a byte-level BPE tokenizers file."""

    START = ("start",)

    def __init__(self, path: str, max_states: int = MAX_STATES):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE without normaliser")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.letters = byte_alphabet()
        made = {*self.letters.values(), *("".join(m) for m in merges)}
        self.tokens = {t for t in made if t in model["vocab"] and self.bpe([t]) == [t]}
        self.open = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and spec["normalizer"] for t in spec["added_tokens"]) or len({s[0] for s in self.specials}) < len(self.specials) or any(s[0] in s[1:] or _SPACE.search(s) for s in self.specials):
            raise ValueError("special strings that overlap, hold white space or take some with them")
        self.opens_special = {s[0]: s for s in self.specials}
        self.letter, self.number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
        self.max = max_states
        self.states: dict[tuple, State] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    # -- BPE

    def bpe(self, parts: list[str]) -> list[str]:
        """The merges applied in the order of their ranks."""
        s = [c for p in parts for c in p]
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: self.rank.get((s[i], s[i + 1]), 1 << 60))
            if (s[best], s[best + 1]) not in self.rank:
                break
            pair, out, i = (s[best], s[best + 1]), [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == pair:
                    out.append(s[i] + s[i + 1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            s = out
        return s

    def stand(self, a: str, b: str) -> bool:
        """Whether BPE leaves the tokens side by side."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.bpe([a, b]) == [a, b]
        return got

    def read(self, inside: tuple, text: str) -> tuple[tuple, int]:
        """``text`` read inside a piece: the new state inside it and the tokens emitted.

        ``inside`` holds (open string, last token before it, tokens that it has fewer
        than the whole prefix); it is empty at a piece's start."""
        emitted = 0
        for byte in text.encode("utf-8", "surrogatepass"):
            c, last, fewer, grown = self.letters[byte], None, 0, []
            for string, before, less in inside or (("", None, 0),):
                string += c
                if last is None and string in self.tokens and (before is None or self.stand(before, string)):
                    last, fewer = string, less
                if string in self.open:
                    grown.append((string, before, less))
            step = 1 - fewer
            emitted += step
            # ("", last, 0): a token may open behind this prefix
            inside = (*((s, b, less + step) for s, b, less in grown), ("", last, 0))
        return inside, emitted

    # -- the pre-tokenizer

    def kind(self, char: str) -> str:
        return "letters" if self.letter.match(char) else "numbers" if self.number.match(char) else "white" if _SPACE.match(char) else "others"

    def opened(self, char: str) -> tuple[tuple, int]:
        """The state after a piece that begins with ``char``."""
        kind = self.kind(char)
        if kind == "white":
            return ("white", (), char), 0
        inside, n = self.read((), char)
        return ("quote" if char == "'" else kind, inside), n

    def plain(self, key: tuple, char: str) -> tuple[tuple, int]:
        """A transition of the pre-tokenizer and BPE, special strings aside."""
        name, kind = key[0], self.kind(char)
        if name == "start":
            return self.opened(char)
        if name == "white":
            inside, pending = key[1:]
            if kind == "white":
                inside, n = self.read(inside, pending)
                return ("white", inside, char), n
            if pending == " ":
                inside, n = self.read((), pending + char)
                return (kind, inside), n
            n = self.read((), pending)[1]
            key, more = self.opened(char)
            return key, n + more
        inside = key[1]
        if name == "quote":
            if char in _SHORT:
                return self.START, self.read((), "'" + char)[1] - 1
            if char in _LONG:
                letters, n = self.read((), char)
                return ("contraction", letters, char), n
            name = "others"
        elif name == "contraction":
            if char == _LONG[key[2]]:
                return self.START, self.read((), "'" + key[2] + char)[1] - 2
            name = "letters"
        if kind == name:
            inside, n = self.read(inside, char)
            return (name, inside), n
        return self.opened(char)

    def ending(self, key: tuple) -> int:
        """Tokens still to be emitted where a text ends in this state."""
        if key[0] == "special":
            return self.ending(key[3])
        return self.read(key[1], key[2])[1] if key[0] == "white" else 0

    def step(self, key: tuple, char: str) -> tuple[tuple, int]:
        """("special", string, characters read of it, state now, tokens emitted since)
        runs beside the plain states until a special string is whole or isn't one."""
        if key[0] == "special":
            _, string, n, now, due = key
            if char == string[n]:
                if n + 1 == len(string):
                    return self.START, 1 + due
                now, emitted = self.plain(now, char)
                return ("special", string, n + 1, now, due - emitted), emitted
            key = now
        now, emitted = self.plain(key, char)
        string = self.opens_special.get(char)
        if string:
            return ("special", string, 1, now, self.ending(key) - emitted), emitted
        return now, emitted

    def state(self, key: tuple) -> State:
        got = self.states.get(key)
        if got is None:
            if len(self.states) >= self.max:
                for s in self.states.values():
                    s.clear()
                self.states.clear()
            got = self.states[key] = State()
            got.key, got.machine, got.final = key, self, self.ending(key)
        return got

    # -- running

    def count(self, text: str) -> int:
        """Tokens emitted from the start state to the end of the text."""
        state, total = self.state(self.START), 0
        for char in text:
            state, n = state[char]
            total += n
        return total + state.final

    def state_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, count, tail) of a chunk; tail None if it never synchronises."""
        first = _SYNC.search(chunk)
        if first is None:
            return chunk, 0, None
        at = last = first.start()
        for m in _SYNC.finditer(chunk, max(at, len(chunk) - 4096)):
            last = m.start()
        return chunk[:at], self.count(chunk[at:last]), chunk[last:]

    def compose(self, a, b):
        """The map of two neighbouring chunks.  Associative."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list):
        """Balanced tree over neighbouring maps."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, whole) -> int:
        """Tokens of a text, given its map."""
        head, n, tail = whole
        return n + (self.count(head) if tail is None else self.count(head) + self.count(tail))


def chunks_of(text: str, size: int) -> Iterator[str]:
    for i in range(0, len(text), size):
        yield text[i : i + size]


_HELD = None


def _transducer(path: str) -> CountTransducer:
    global _HELD
    if _HELD is None or _HELD[0] != path:
        _HELD = (path, CountTransducer(path))
    return _HELD[1]


def giant_chunks(giants: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``row, k, chunk`` of ``row, text``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                chunks = [*chunks_of(text.as_py(), chunk_chars)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.string())], ["row", "k", "chunk"])

    return giants.select("row", "text").mapInArrow(cut, "row long, k int, chunk string")


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_tokens.

    Texts up to ``chunk_chars`` are one chunk and are counted where they are read;
    longer ones are written with a name of their own (so that a task that runs again
    deals the same one), cut into chunks that are dealt over the cluster, mapped there,
    and combined per document (only heads, tails and counts are shuffled then).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), (F.length(text) > chunk_chars).alias("giant"), F.monotonically_increasing_id().alias("row"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(tokenizer_path)
        for batch in batches:
            giant = batch.column("giant").to_pylist()
            texts = batch.column("text")
            n = [None if g else machine.count(t.as_py()) for g, t in zip(giant, texts, strict=True)]
            held = pa.array([t.as_py() if g else None for g, t in zip(giant, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64()), batch.column("row"), held], ["id", "n_bytes", "n_tokens", "row", "text"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(tokenizer_path)
        for batch in batches:
            m = [machine.state_map(c.as_py()) for c in batch.column("chunk")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), *(pa.array([x[i] for x in m], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string())))], ["row", "k", "head", "count", "tail"])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        machine = _transducer(tokenizer_path)
        pdf = pdf.sort_values("k")
        whole = machine.scan([(h, int(c), t if isinstance(t, str) else None) for h, c, t in zip(pdf["head"], pdf["count"], pdf["tail"], strict=True)])
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "n": [machine.total(whole)]})

    counted = written(named.mapInArrow(short, f"id {id_type}, n_bytes long, n_tokens long, row long, text string"))
    cuts = giant_chunks(counted.where("text is not null"), chunk_chars)
    mapped = cuts.repartition("row", "k").mapInArrow(maps, "row long, k int, head string, count long, tail string")
    long = mapped.groupBy("row").applyInPandas(combine, "row long, n long")
    whole = counted.where("text is null").select("id", "n_bytes", "n_tokens")
    combined = counted.where("text is not null").select("row", "id", "n_bytes").join(long, "row").select("id", "n_bytes", F.col("n").alias("n_tokens"))
    return whole.unionByName(combined).withColumnRenamed("id", id_col)
