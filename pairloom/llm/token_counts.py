"""Token counts of byte-level BPE by compiled finite-state transducers.

Two deterministic transducers are composed:

* the splitter, a small table over character classes, whose transitions emit the starts of
  pretokens. A text is cut into chunks that are run in lockstep. Each chunk gives a state map (for
  every start state: the end state and what is emitted), the maps are composed by a parallel prefix
  scan, and then each chunk's start state is known;
* the merger, over the bytes of one pretoken, whose transitions carry the change of the number of
  tokens. Its states are compiled when first met and then kept. A state is the longest suffix read
  that begins a token of the vocabulary, with the last token and the relative count at each place
  in it, which is all that the encoding of further bytes depends on.

The count of a pretoken is the sum along its path. No text is cut off: a pretoken or a text of any
length is read whole. What is kept between texts is bounded: states, pairs of tokens, and pretokens
by their letters (pretokens over LONG letters are not kept); beyond a bound it is compiled anew.

Defined cases: null counts as empty (0 tokens); the vocabulary's special strings inside a text are
one token each, as is the library's default, and split the text there; repeated rows get equal
counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from pairloom.llm.common import map_texts

#: Character classes of the splitter. The contraction letters have classes of their own.
CLASSES = ["letter", "final", "r", "v", "l", "e", "number", "space", "blank", "apostrophe", "other", "end"]
LETTERS = {"letter", "final", "r", "v", "l", "e"}
#: fresh states begin a pretoken; after_* have read an apostrophe and a letter that needs a second one.
STATES = ["start", "letters", "numbers", "others", "quote", "after_r", "after_v", "after_l", "done", "space1", "blank1", "space2", "blank2"]
HERE, BEFORE = 1, 2
#: Letters of a pretoken that is worth keeping.
LONG = 200
#: White space of Unicode.
BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _fresh(kind: str) -> str:
    if kind in LETTERS:
        return "letters"
    return {"number": "numbers", "space": "space1", "blank": "blank1", "apostrophe": "quote", "other": "others", "end": "start"}[kind]


def _step(state: str, kind: str) -> tuple[str, int]:
    """The next state, and whether a pretoken starts at this character, the one before it, or both."""
    if kind == "end":
        return "start", BEFORE if state.startswith("after_") else 0
    blank = kind in ("space", "blank")
    if state == "start":
        return _fresh(kind), HERE
    if state in ("space1", "blank1", "space2", "blank2"):
        if blank:
            return ("space2" if kind == "space" else "blank2"), 0
        late = BEFORE if state.endswith("2") else 0
        if state.startswith("blank"):
            return _fresh(kind), late | HERE
        return ("others" if kind in ("apostrophe", "other") else _fresh(kind)), late
    same = {"letters": kind in LETTERS, "numbers": kind == "number", "others": kind in ("other", "apostrophe"), "quote": kind in ("other", "apostrophe")}.get(state, False)
    if same:
        return ("others" if state == "quote" else state), 0
    if state == "quote" and kind in LETTERS - {"letter", "e"}:
        return ("done" if kind == "final" else f"after_{kind}"), 0
    if state in ("after_r", "after_v") and kind == "e" or state == "after_l" and kind == "l":
        return "done", 0
    if state.startswith("after_"):  # no contraction: the apostrophe stands alone, the letter starts a pretoken
        return ("letters", BEFORE) if kind in LETTERS else (_fresh(kind), BEFORE | HERE)
    return _fresh(kind), HERE


class Splitter:
    """Pretoken starts of a text, by lockstep over chunks and a prefix scan of their state maps."""

    def __init__(self, chunk: int = 128):
        self.chunk = chunk
        self.n_classes = len(CLASSES)
        steps = [[_step(s, c) for c in CLASSES] for s in STATES]
        self.goes = np.array([[STATES.index(t) for t, _ in row] for row in steps], np.uint8).ravel()
        self.emits = np.array([[e for _, e in row] for row in steps], np.uint8).ravel()
        kinds = np.full(0x110000, CLASSES.index("other"), np.uint8)
        for cp in range(0x110000):
            major = unicodedata.category(chr(cp))[0]
            if major in "LN":
                kinds[cp] = CLASSES.index("letter" if major == "L" else "number")
        kinds[BLANKS] = CLASSES.index("blank")
        kinds[0x20], kinds[ord("'")] = CLASSES.index("space"), CLASSES.index("apostrophe")
        for letter in "rvle":
            kinds[ord(letter)] = CLASSES.index(letter)
        kinds[[ord(x) for x in "stmd"]] = CLASSES.index("final")
        self.kinds = kinds

    def classes(self, text: str) -> np.ndarray:
        return self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def starts(self, kinds: np.ndarray) -> np.ndarray:
        """Boolean per character: a pretoken starts here. kinds has to close with the class end."""
        n, lanes = len(kinds), -(-len(kinds) // self.chunk)
        grid = np.full(lanes * self.chunk, CLASSES.index("end"), np.uint8)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(lanes, self.chunk).T).astype(np.intp)
        maps = self._scan(self._maps(grid))
        state = np.zeros(lanes, np.intp)
        state[1:] = maps[:-1, STATES.index("start")]
        out = np.empty((self.chunk, lanes), np.uint8)
        for i in range(self.chunk):
            at = state * self.n_classes + grid[i]
            out[i] = self.emits[at]
            state = self.goes[at].astype(np.intp)
        out = np.ascontiguousarray(out.T).ravel()
        here = (out & HERE) > 0
        here[:-1] |= (out[1:] & BEFORE) > 0
        return here[:n]

    def _maps(self, grid: np.ndarray) -> np.ndarray:
        """End state of each chunk (rows) for each start state (columns).

        Start states mostly meet after a few characters; a chunk whose states have all met goes on
        with one.
        """
        lanes, k = grid.shape[1], len(STATES)
        maps = np.tile(np.arange(k, dtype=np.intp), (lanes, 1))
        head = min(8, self.chunk)
        for i in range(head):
            maps = self.goes[maps * self.n_classes + grid[i][:, None]].astype(np.intp)
        met = (maps == maps[:, :1]).all(1)
        one, rest = maps[met, 0], maps[~met]
        ones, rests = grid[:, met], grid[:, ~met]
        for i in range(head, self.chunk):
            one = self.goes[one * self.n_classes + ones[i]].astype(np.intp)
        for i in range(head, self.chunk) if len(rest) else ():
            rest = self.goes[rest * self.n_classes + rests[i][:, None]].astype(np.intp)
        maps[met], maps[~met] = one[:, None], rest
        return maps

    @staticmethod
    def _scan(maps: np.ndarray) -> np.ndarray:
        """Inclusive prefix composition of state maps, in log2(chunks) rounds."""
        step = 1
        while step < len(maps):
            later = np.take_along_axis(maps[step:], maps[:-step], 1)
            maps = np.concatenate([maps[:step], later])
            step *= 2
        return maps


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merger:
    """Transducer over bytes whose weights sum to the number of BPE tokens of what was read."""

    def __init__(self, merges: list[tuple[bytes, bytes]], most_states: int = 400_000, most_pairs: int = 1_000_000):
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        self.tokens = set(tokens)
        self.begins = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.most_states, self.most_pairs = most_states, most_pairs
        self._reset()

    def _reset(self) -> None:
        #: A state: what was read last, the last token at each place in it, the count there less the count at its end.
        first = (b"", (b"",), (0,))
        self.ids, self.states, self.moves = {first: 0}, [first], [{}]

    def _encode(self, text: bytes) -> list[bytes]:
        parts = [bytes([b]) for b in text]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _follows(self, a: bytes, b: bytes) -> bool:
        """Whether an encoding can have token b right after token a."""
        if not a:
            return True
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[a, b] = self._encode(a + b) == [a, b]
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        read, last, count = self.states[state]
        text = read + bytes([byte])
        for size in range(len(text), 0, -1):
            at = len(text) - size
            if (token := text[at:]) in self.tokens and (at > 0 or last[0] == b"" or at < len(last)) and self._follows(last[at], token):
                break
        more = count[at] + 1
        for cut in range(len(text) + 1):
            if cut == len(text) or text[cut:] in self.begins:
                break
        lasts, counts = (*last[cut:], token), (*(c - more for c in count[cut:]), 0)
        key = (text[cut:], lasts, counts)
        if (to := self.ids.get(key)) is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][byte] = (to, more)
        return to, more

    def count(self, word: bytes) -> int:
        if len(self.states) > self.most_states:
            self._reset()
        state, total, moves, most = 0, 0, self.moves, 2 * self.most_states
        for byte in word:
            state, delta = moves[state].get(byte) or self._compile(state, byte)
            total += delta
            if len(moves) > most:  # within one long pretoken: go on from the state that is reached
                here = self.states[state]
                self._reset()
                self.ids[here], moves, state = 1, self.moves, 1
                self.states.append(here)
                moves.append({})
        return total


class TokenCounter:
    """Counts for one byte-level BPE vocabulary file."""

    def __init__(self, path: str, most_letters: int = 16_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merger = Merger([(raw(a), raw(b)) for a, b in pairs])
        specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.splitter = Splitter()
        self.words: dict[str, int] = {}
        self.letters, self.most_letters = 0, most_letters

    def _parts(self, text: str) -> list[str]:
        return self.specials.split(text) if self.specials else [text]

    def _count(self, word: str) -> int:
        if (n := self.words.get(word)) is None:
            n = self.merger.count(word.encode("utf-8", "replace"))
            if len(word) <= LONG:
                self.words[word] = n
                self.letters += len(word)
        return n

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        parts = [self._parts(t) for t in texts]
        flat = [p for ps in parts for p in ps]
        lengths = np.fromiter((len(p) for p in flat), np.int64, len(flat))
        joined = "\n".join(flat) + "\n"
        kinds = self.splitter.classes(joined)
        ends = np.cumsum(lengths + 1) - 1
        kinds[ends] = CLASSES.index("end")
        starts = np.flatnonzero(self.splitter.starts(kinds))
        # A pretoken ends where the next one starts, or at the end of its part.
        part_of = np.searchsorted(ends, starts, "left")
        stops = np.minimum(np.append(starts[1:], len(joined)), ends[part_of]) if len(starts) else starts
        if self.letters > self.most_letters:
            self.words.clear()
            self.letters = 0
        found = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        own = {w: self._count(w) for w in set(found)}
        each = np.fromiter(map(own.__getitem__, found), np.int64, len(found))
        per_part = np.bincount(part_of, each, len(flat)).astype(np.int64)
        sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        first = np.cumsum(sizes) - sizes
        return (np.add.reduceat(per_part, first) if len(parts) else per_part) + sizes - 1


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The compiled counter of a vocabulary file; compiled once in each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The installed file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document.

    path: the vocabulary's file, the same on every executor; by default the installed one.
    """

    def work(texts: list[str]) -> list:
        n = counter(path or vocabulary()).counts(texts)
        return [[len(t.encode("utf-8", "replace")) for t in texts], n, n > limit]

    return map_texts(docs, work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)
