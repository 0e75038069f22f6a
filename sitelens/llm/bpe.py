"""BPE encoding and decoding through a minimal acyclic transducer (operator 12).

``compile_lexicon`` counts the words of all documents, takes the ``LEXICON_WORDS`` most frequent ones and
compiles them into a minimal acyclic automaton over UTF-8 bytes (states with equal right languages are one).
Every arc carries an additive output; their sum along a word is the word's place in a table of id sequences.
The automaton is laid out as a double array in one file of the shared checkpoint folder, which Spark's file
distribution brings to the executors and Python workers map into memory.  ``encode`` segments texts on code
points, walks all words of a block through the arrays at once, and merges the words that the lexicon does
not hold pair by pair, lowest rank first (exact for any word; the lexicon decides only the speed).
``decode`` joins token strings with a blank, as a file without a decoder asks for.

The file must be a BPE with a word-end suffix, byte-level alphabet and no decoder, whose pre-tokeniser
cuts contractions, letter runs, single digits and other runs; anything else raises.  How code points
are classed and lower-cased is read off the tokenizers library, so both follow one Unicode version.

Defined cases: a null, empty or blank text has no ids and decodes to the empty string; the strings of
special tokens give their ids (``specials=False``: they are ordinary text); repeated rows and ids are rows
of their own; ids that the vocabulary lacks (and nulls among them) decode to nothing; extra columns, whatever their names,
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitelens.llm.common import blocks, prefix_hash, span_hash, utf8
from sitelens.session import ensure_checkpoint_dir

#: Words of the lexicon; further words are merged.
LEXICON_WORDS = 65_536
#: Longer words are always merged, one by one.
LEXICON_BYTES = 48
#: Bases that a state is tried at together.
WINDOW = 1024

SPACE, LETTER, DIGIT, OTHER = range(4)
#: Pre-tokeniser and byte alphabet of the file kind (fixed values).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points below this, and general punctuation, are stable under composition whatever stands beside them.
STABLE = 0x300
PUNCTUATION = (0x2010, 0x205F)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def code_point_classes(tokenizer: Tokenizer) -> np.ndarray:
    """SPACE, LETTER, DIGIT or OTHER of every code point, as the tokeniser's own splitter sees them."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cut = lambda s: [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(s)]
    classes = np.zeros(0x110000, np.uint8)
    where = np.array(points)
    for a, b in cut("".join(map(chr, points))):  # a run of one class, or one digit; blanks are cut out
        first = chr(points[a])
        kind = LETTER if len(cut(f"a{first}")) == 1 else OTHER if len(cut(f"!{first}")) == 1 else DIGIT
        classes[where[a:b]] = kind
    return classes


def lower_cases(tokenizer: Tokenizer) -> np.ndarray:
    """The normal form of code points below ``STABLE``, or 0xFFFF where it is not one code point."""
    forms = [tokenizer.normalizer.normalize_str(chr(c)) for c in range(STABLE)]
    return np.array([ord(f) if len(f) == 1 else 0xFFFF for f in forms], np.uint32)


class Merges:
    """Exact pair merging of words that the lexicon lacks: the pair of lowest rank, the first of equals, goes first."""

    def __init__(self, letters: np.ndarray, pairs: np.ndarray):
        self.letters = letters.reshape(2, 256)  # ids of single bytes: inside a word, at its end
        pairs = pairs.reshape(-1, 3).astype(np.int64)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        self.order = np.append(np.argsort(keys, kind="stable"), len(keys))  # the last rank stands for no pair
        self.keys, self.made = np.append(keys[self.order[:-1]], np.iinfo(np.int64).max), np.append(pairs[:, 2], -1)
        self.none = len(keys)

    @functools.cached_property
    def rank(self) -> dict[tuple[int, int], tuple[int, int]]:
        return {(int(k) >> 32, int(k) & 0xFFFFFFFF): (int(r), int(self.made[r])) for k, r in zip(self.keys[:-1], self.order)}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (right >= 0), self.order[at], self.none)

    def all(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word); words of up to LEXICON_BYTES merge all at once, a pair each a round."""
        counts = np.zeros(len(starts), np.int64)
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], LEXICON_BYTES, side="right"))
        parts, rows = [], []
        for a in range(0, short, 1024):
            at = order[a:min(short, a + 1024)]
            ids, counts[at] = self._together(data, starts[at], sizes[at])
            parts.append(ids)
            rows.append(np.repeat(at, counts[at]))
        for w in order[short:].tolist():
            ids = self._merged(data[starts[w]:starts[w] + sizes[w]].tobytes())
            counts[w] = len(ids)
            parts.append(np.array(ids, np.int64))
            rows.append(np.full(len(ids), w))
        if not parts:
            return np.zeros(0, np.int64), counts
        return np.concatenate(parts)[np.argsort(np.concatenate(rows), kind="stable")], counts

    def _together(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(sizes.max())
        column = np.arange(width)
        inside = column < sizes[:, None]
        letters = data[np.minimum(starts[:, None] + column, starts[:, None] + sizes[:, None] - 1)]
        ids = np.where(column == sizes[:, None] - 1, self.letters[1][letters], self.letters[0][letters]).astype(np.int64)
        ids = np.concatenate([np.where(inside, ids, -1), np.full((len(ids), 1), -1)], 1)  # a column of ends
        rank = self.ranks(ids[:, :-1], ids[:, 1:])  # of the pair that begins in each column
        counts, live = sizes.astype(np.int64), np.arange(len(ids))
        while len(live):
            at = rank[live].argmin(1)
            best = rank[live, at]
            live, at, best = (x[best < self.none] for x in (live, at, best))
            if not len(live):
                break
            row, shift = np.arange(len(live)), column + (column > at[:, None])
            left = np.take_along_axis(ids[live], shift, 1)
            left[row, at] = self.made[best]
            ids[live, :-1] = left
            kept = np.concatenate([rank[live], np.full((len(live), 1), self.none)], 1)
            kept = np.take_along_axis(kept, shift, 1)
            kept[row, at] = self.ranks(left[row, at], ids[live, at + 1])
            before = np.maximum(at - 1, 0)
            kept[row, before] = np.where(at > 0, self.ranks(left[row, before], left[row, at]), kept[row, before])
            rank[live] = kept
            counts[live] -= 1
        return ids[:, :-1][column < counts[:, None]], counts

    def _merged(self, word: bytes) -> list[int]:
        """One long word, by a queue of pairs."""
        inner, last = self.letters.tolist()
        ids = [inner[b] for b in word]
        ids[-1] = last[word[-1]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] < n:
                found = self.rank.get((ids[at], ids[after[at]]))
                if found:
                    heapq.heappush(queue, (found[0], at, found[1]))

        for at in range(n - 1):
            offer(at)
        while queue:
            _, at, to = heapq.heappop(queue)
            if ids[at] is None or after[at] >= n:
                continue
            right = after[at]
            if self.rank.get((ids[at], ids[right]), (0, -1))[1] != to:
                continue  # one of the two was merged since
            ids[at], ids[right] = to, None
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            offer(before[at])
            offer(at)
        return [x for x in ids if x is not None]


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """(arcs, final, root) of the minimal acyclic automaton of sorted distinct words."""
    arcs: list[dict[int, int]] = []
    final: list[bool] = []
    register: dict[tuple, int] = {}

    def settled(node: tuple[dict[int, int], bool]) -> int:
        key = (node[1], *node[0].items())
        if key not in register:
            register[key] = len(arcs)
            arcs.append(node[0])
            final.append(node[1])
        return register[key]

    path: list[list] = [[{}, False]]  # the states of the last word, from the root on, still open
    last = b""
    for word in [*words, None]:
        common = 0
        if word is not None:
            limit = min(len(word), len(last))
            while common < limit and word[common] == last[common]:
                common += 1
        while len(path) - 1 > common:  # no later word goes through these states: they are settled
            node = path.pop()
            path[-1][0][last[len(path) - 1]] = settled((node[0], node[1]))
        if word is None:
            break
        path.extend([{}, False] for _ in range(len(word) - common))
        path[-1][1] = True
        last = word
    return arcs, final, settled((path[0][0], path[0][1]))


def double_array(arcs: list[dict[int, int]], final: list[bool]) -> dict[str, np.ndarray]:
    """base, check, target, add, final: arc b of state s is at base[s] + b if check there is s."""
    counts = [0] * len(arcs)
    for s, out in enumerate(arcs):  # targets are settled before their sources
        counts[s] = int(final[s]) + sum(counts[t] for t in out.values())
    size = sum(map(len, arcs)) * 2 + 2 * WINDOW
    check = np.full(size, -1, np.int32)
    target, add = np.zeros(size, np.int32), np.zeros(size, np.int32)
    base = np.zeros(len(arcs) + 1, np.int32)  # the last state is dead: no check names it
    free_from = 256
    for s in sorted(range(len(arcs)), key=lambda s: -len(arcs[s])):
        labels = np.array(sorted(arcs[s]), np.int64)
        if not len(labels):
            continue
        hit, at = None, free_from - int(labels[0])
        while hit is None:
            if at + WINDOW + 256 > len(check):
                check, target, add = (np.concatenate([a, np.full(len(a) // 2, fill, np.int32)]) for a, fill in ((check, -1), (target, 0), (add, 0)))
                continue
            hits = np.arange(at, at + WINDOW)
            for b in labels.tolist():  # bases where every arc finds a free place
                hits = hits[check[hits + b] < 0]
            hit, at = (int(hits[0]), at) if len(hits) else (None, at + WINDOW)
        base[s] = hit
        before = int(final[s])
        for b in labels.tolist():
            check[hit + b], target[hit + b], add[hit + b] = s, arcs[s][b], before
            before += counts[arcs[s][b]]
        free = np.flatnonzero(check[free_from:free_from + WINDOW] < 0)
        free_from += int(free[0]) if len(free) else WINDOW
    return {"base": base, "check": check, "target": target, "add": add, "final": np.array([*final, False], np.uint8)}


class Lexicon:
    """The compiled file, mapped into memory; sections are views of the map."""

    def __init__(self, path: str):
        self.data = np.asarray(np.memmap(path, np.uint8, "r"))
        head = int(self.data[:8].view(np.int64)[0])
        for name, kind, start, length in json.loads(self.data[8:8 + head].tobytes()):
            setattr(self, name, self.data[start:start + length].view(kind))
        self.merges = Merges(self.letters, self.pairs)
        self.root = int(self.start[0])
        frame = json.loads(self.frame.tobytes())
        self.normalizer = Tokenizer.from_str(json.dumps(frame["tokenizer"])).normalizer
        self.specials = frame["specials"]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None

    def pieces(self, text: str, specials: bool) -> Iterator[tuple[str, int]]:
        """(normalised text between special tokens, -1) and ("", id) of special tokens."""
        at = 0
        for m in self.special.finditer(text) if specials and self.special else ():
            yield self.normal(text[at:m.start()]), -1
            yield "", self.specials[m.group()]
            at = m.end()
        yield self.normal(text[at:] if at else text), -1

    def normal(self, text: str) -> str:
        if text.isascii():
            return text
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        low = points < STABLE
        stable = low & (self.lower[np.where(low, points, 0)] != 0xFFFF) | (points >= PUNCTUATION[0]) & (points < PUNCTUATION[1])
        return text if stable.all() else self.normalizer.normalize_str(text)

    def segment(self, texts: list[str], specials: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, text index, special id or -1) of the pre-tokens of some texts, in order."""
        pieces, owner, marks = [], [], []
        for d, text in enumerate(texts):
            for piece, mark in self.pieces(text, specials):
                pieces.append(piece)
                owner.append(d)
                marks.append(mark)
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        low = points < STABLE
        points = np.where(low, self.lower[np.where(low, points, 0)], points)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        n = len(points)
        kind = self.classes[points]
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        start[bounds[:-1][bounds[:-1] < n]] = True
        start &= kind != SPACE
        self._contractions(points, kind, start, bounds)
        stops = np.flatnonzero(start | (kind == SPACE))
        first = np.flatnonzero(start)
        after = np.append(stops, n)[np.searchsorted(stops, first, side="right")]
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        piece = np.searchsorted(bounds, first, side="right") - 1
        marked = np.flatnonzero(np.array(marks) >= 0)
        # special tokens stand between the words of the pieces around them
        place = np.argsort(np.concatenate([piece, marked]), kind="stable")
        take = lambda a, b: np.concatenate([a, b])[place]
        none = np.zeros(len(marked), np.int64)
        return (data, take(byte_at[first], none), take(byte_at[after], none),
                np.array(owner)[take(piece, marked)], take(np.full(len(first), -1), np.array(marks)[marked]))

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, start: np.ndarray, bounds: np.ndarray) -> None:
        """An apostrophe that begins a token takes a following s, t, m, d, re, ve or ll with it."""
        n = len(points)
        at = np.flatnonzero(start & (points == ord("'")))
        if not len(at):
            return
        end = bounds[np.searchsorted(bounds, at, side="right")]  # of the piece
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (at + 1 < end)
        long = np.isin(one * 0x200 + two, [ord(a) * 0x200 + ord(b) for a, b in ("re", "ve", "ll")]) & (two < 0x200) & (at + 2 < end)
        for hit, size in ((short, 2), (long, 3)):
            p = at[hit]
            start[p + 1] = False
            rest = p + size
            inside = rest < end[hit]
            rest = rest[inside]
            start[rest[kind[rest] == LETTER]] = True

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table row of each word, -1 for words that the lexicon lacks: all words walk at once."""
        out = np.full(len(starts), -1, np.int64)
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        order = order[(size[order] <= LEXICON_BYTES) & (size[order] > 0)]
        at, size = starts[order], size[order]
        dead = len(self.base) - 1
        state = np.full(len(order), self.root, np.int32)
        total = np.zeros(len(order), np.int64)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, side="left"))  # words longer than step
            s = state[:live]
            arc = self.base[s] + data[at[:live] + step]
            found = self.check[arc] == s
            total[:live] += self.add[arc]
            state[:live] = np.where(found, self.target[arc], dead)
        hit = self.final[state] == 1
        out[order[hit]] = total[hit]
        return out

    def encode(self, texts: list[str], specials: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of text d are ids[bounds[d]:bounds[d + 1]]."""
        data, starts, ends, owner, marks = self.segment(texts, specials)
        place = self.places(data, starts, ends)
        size = np.diff(self.spans)[np.maximum(place, 0)] if len(self.spans) > 1 else np.zeros(len(place), np.int64)
        begin = self.spans[np.maximum(place, 0)]
        marked, unseen = np.flatnonzero(marks >= 0), np.flatnonzero((place < 0) & (marks < 0))
        extra, size[unseen] = self.merges.all(data, starts[unseen], (ends - starts)[unseen])
        extra, size[marked] = np.concatenate([extra, marks[marked]]), 1
        other = np.concatenate([unseen, marked])
        begin[other] = len(self.ids) + np.cumsum(size[other]) - size[other]
        pool = np.concatenate([self.ids, extra.astype(np.int32)])
        ids = pool[ragged(begin, size)]
        per_text = np.bincount(owner, size, len(texts)).astype(np.int64) if len(owner) else np.zeros(len(texts), np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the token strings joined by blanks."""
        held = (ids >= 0) & (ids < len(self.names) - 1)
        keep = held & (np.diff(self.names)[np.where(held, ids, 0)] > 0)
        counts = np.concatenate([[0], np.cumsum(keep)])[bounds]
        ids = ids[keep]
        size = np.diff(self.names)[ids]  # each name ends with a blank
        where = ragged(self.names[ids], size)
        ends = np.concatenate([[0], np.cumsum(size)])[counts]
        text = self.name_bytes[where]
        drop = ends[1:][np.diff(counts) > 0] - 1  # the blank after a text's last token
        return np.delete(text, drop), ends - np.concatenate([[0], np.cumsum(np.diff(counts) > 0)])


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], ..., begin[0] + size[0] - 1, begin[1], ... as one array."""
    total = np.cumsum(size)
    if not len(size) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(begin - (total - size), size) + np.arange(int(total[-1]))


def _sections(path: str) -> dict[str, np.ndarray]:
    """The parts of the file that the tokenizer file alone decides."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, text = spec["model"], json.dumps(spec.get("pre_tokenizer"))
    suffix = model.get("end_of_word_suffix")
    plain = model["type"] == "BPE" and suffix and not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
    if not plain or spec.get("decoder") or json.dumps(SPLIT) not in text or "ByteLevel" not in text or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: not a byte-level BPE with word ends and the expected splitter")
    tokenizer = Tokenizer.from_file(path)
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    names = [""] * (1 + max([*vocab.values(), *specials.values()]))
    for name, i in [*vocab.items(), *specials.items()]:
        names[i] = name
    raw = [f"{name} ".encode() if name else b"" for name in names]
    alphabet = byte_alphabet()
    frame = {"specials": specials, "tokenizer": {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": spec["normalizer"], "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}}
    return {
        "classes": code_point_classes(tokenizer), "lower": lower_cases(tokenizer),
        "letters": np.array([vocab[c + end] for end in ("", suffix) for c in alphabet], np.int32),
        "pairs": np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32).reshape(-1),
        "names": np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), "name_bytes": np.frombuffer(b"".join(raw), np.uint8),
        "frame": np.frombuffer(json.dumps(frame).encode(), np.uint8),
    }


@functools.lru_cache(4)
def tokenizer_sections(path: str) -> dict[str, np.ndarray]:
    return _sections(path)


def compiled(tokenizer: str, words: list[bytes]) -> bytes:
    """The file: a JSON table of sections, then the sections, each on a multiple of eight."""
    sections = dict(tokenizer_sections(tokenizer))
    words = sorted(set(words))
    arcs, final, root = minimal_automaton(words)
    merges = Merges(sections["letters"], sections["pairs"])
    lengths = np.array([len(w) for w in words], np.int64)
    ids, counts = merges.all(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths)
    sections |= double_array(arcs, final)
    sections["start"] = np.array([root], np.int64)
    sections["spans"] = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    sections["ids"] = ids.astype(np.int32)
    align = lambda n: -(-n // 8) * 8
    reserve = 2048
    table, at = [], 8 + reserve
    for name, a in sections.items():
        table.append((name, a.dtype.str, at, a.nbytes))
        at = align(at + a.nbytes)
    head = json.dumps(table).encode().ljust(reserve)
    body = b"".join(a.tobytes().ljust(align(a.nbytes), b"\0") for a in sections.values())
    return np.array([len(head)], np.int64).tobytes() + head + body


def _ship(spark: SparkSession, content: bytes) -> str:
    """Write a file to the shared checkpoint folder and have Spark bring it to every executor; its name."""
    name = f"sitelens-lexicon-{uuid.uuid4().hex}.bin"
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sitelens-llm/{name}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(conf).create(path)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    spark.sparkContext.addFile(place)
    return name


@functools.lru_cache(2)
def opened(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    data, offsets, _ = utf8(column)
    for i, j in blocks(offsets):
        yield i, j, [data[offsets[d]:offsets[d + 1]].tobytes().decode() for d in range(i, j)]


def _counted(name: str, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = opened(name)
        for batch in batches:
            for _, _, texts in _texts(batch.column(0)):
                data, starts, ends, _, marks = lexicon.segment(texts, specials)
                short = (marks < 0) & (ends - starts <= LEXICON_BYTES)
                starts, ends = starts[short], ends[short]
                _, at, n = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_counts=True)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[starts[w]:ends[w]] for w in at.tolist()], pa.binary()), pa.array(n.astype(np.int64))], ["word", "n"])
    return run


def compile_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", specials: bool = True, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all documents; the distributed file's name.

    Word counts come from a Spark aggregation with partial sums (no order within a word's rows matters); only the
    ``words`` most frequent that occur twice reach the driver.
    """
    spark = docs.sparkSession
    empty = _ship(spark, compiled(tokenizer, []))
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted(empty, specials), "word binary, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(words)
    return _ship(spark, compiled(tokenizer, [bytes(w) for w in top.select("word").toArrow()["word"].to_pylist()]))


def _encoded(name: str, specials: bool, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = opened(name)
        for batch in batches:
            for i, j, texts in _texts(batch.column(1)):
                ids, bounds = lexicon.encode(texts, specials)
                out = [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
                if decoded:
                    out.append(_strings(*lexicon.decode(ids, bounds)))
                yield pa.RecordBatch.from_arrays(out, ["id", "ids", "decoded"][:len(out)])
    return run


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def _decoded(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = opened(name)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = batch.column(1).slice(a, 64)
                bounds = np.concatenate([[0], np.cumsum(np.asarray(rows.value_lengths().fill_null(0)))]).astype(np.int64)
                ids = np.asarray(rows.flatten().fill_null(-1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 64), _strings(*lexicon.decode(ids, bounds))], ["id", "decoded"])
    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", specials: bool = True, decoded: bool = False, lexicon: str | None = None) -> DataFrame:
    """``id_col``, ids (array of int) and, if asked for, decoded (string) of every row.

    ``lexicon``: the name that ``compile_lexicon`` gave (else one is compiled from these documents).
    """
    name = lexicon or compile_lexicon(docs, tokenizer, text_col, specials)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_encoded(name, specials, decoded), f"id {kind}, ids array<int>" + (", decoded string" if decoded else ""))
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, lexicon: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and decoded (string) of every row of ids."""
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_decoded(lexicon), f"id {kind}, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    out = encode(docs, tokenizer, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
