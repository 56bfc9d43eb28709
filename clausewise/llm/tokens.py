"""Token counts by a finite-state transducer.

A tokenizer file of the word-piece-with-word-ends kind is compiled into two machines.

* ``Splitter``: a deterministic transducer over character classes, 7 states, that marks where a
  pre-token starts. A text is cut into chunks of equal length; each chunk's state map (start state
  to end state) is computed for all states and all chunks in step, the maps are composed by a
  parallel prefix scan, and with every chunk's true start state known a last pass annotates the
  transitions that emit a pre-token. Contractions need one look-ahead, which the class of the
  apostrophe carries.
* ``WordMachine``: the transitions over whole pre-tokens, annotated with the number of tokens that
  they emit. Transitions are compiled when first met, by the merge ranks of the file, and kept in a
  bounded table.

The sum of emitted counts by document is the library's count: without begin, end or added special
tokens, special strings inside texts counting one each. Texts are processed whole. Null texts
are empty and have no tokens. Row order and repeated rows do not matter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of a normalised batch that are split in one go.
BATCH_CHARS = 1 << 22
CHUNK = 256
#: Entries of the word table before it starts anew.
TABLE = 400_000

# character classes
SPACE, LETTER, DIGIT, OTHER, APOS2, APOS3 = range(6)
# states: between pre-tokens, letters, digit, other signs, 1 or 2 letters of a contraction left, contraction done
GAP, IN_LETTERS, AFTER_DIGIT, IN_OTHER, LEFT1, LEFT2, DONE = range(7)


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission (1: a pre-token starts) by state and class."""
    go = np.zeros((7, 6), np.uint8)
    emit = np.zeros((7, 6), np.uint8)
    fresh = {SPACE: (GAP, 0), LETTER: (IN_LETTERS, 1), DIGIT: (AFTER_DIGIT, 1), OTHER: (IN_OTHER, 1), APOS2: (LEFT1, 1), APOS3: (LEFT2, 1)}
    for state in range(7):
        for c, (to, start) in fresh.items():
            if state == IN_LETTERS and c == LETTER:
                start = 0
            if state == IN_OTHER and c in (OTHER, APOS2, APOS3):
                to, start = IN_OTHER, 0
            if state in (LEFT1, LEFT2):
                to, start = (DONE if state == LEFT1 else LEFT1), 0
            go[state, c], emit[state, c] = to, start
    return go, emit


def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", SPACE)):
        hits = regex.compile(f"{pattern}+").finditer(every)
        for m in hits:
            table[points[m.start() : m.end()]] = c
    return table


class Splitter:
    def __init__(self) -> None:
        self.go, self.emit = transitions()
        self.classes = class_table()

    def classify(self, codes: np.ndarray) -> np.ndarray:
        c = self.classes[codes]
        at = np.flatnonzero(codes == ord("'"))
        if len(at):
            pad = np.concatenate([codes, np.zeros(2, codes.dtype)])
            one, two = pad[at + 1], pad[at + 2]
            is2 = np.isin(one, [ord(x) for x in "stmd"])
            is3 = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            c[at[is2]] = APOS2
            c[at[is3]] = APOS3
        return c

    def starts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flags of pre-token starts, and the classes."""
        c = self.classify(codes)
        n = len(c)
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, SPACE, np.uint8)
        grid[:n] = c
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        states = self.go.shape[0]
        flat = self.go.ravel()
        # state maps of all chunks, all start states in step
        maps = np.repeat(np.arange(states, dtype=np.uint8)[:, None], rows, axis=1)
        for j in range(CHUNK):
            maps = flat[maps * np.uint8(6) + grid[j]]
        entry = self.prefix_scan(maps)
        emitted = self.emit.ravel()
        out = np.empty((CHUNK, rows), np.uint8)
        state = entry
        for j in range(CHUNK):
            k = state * np.uint8(6) + grid[j]
            out[j] = emitted[k]
            state = flat[k]
        return out.T.ravel()[:n], c

    @staticmethod
    def prefix_scan(maps: np.ndarray) -> np.ndarray:
        """The state in which each chunk starts, from GAP: inclusive scan of map composition, shifted by one."""
        scan = maps.copy()
        rows = maps.shape[1]
        step = 1
        while step < rows:
            later = scan[:, step:]
            scan[:, step:] = np.take_along_axis(later, scan[:, :-step].astype(np.intp), axis=0)
            step *= 2
        entry = np.empty(rows, np.uint8)
        entry[0] = GAP
        entry[1:] = scan[GAP, :-1]
        return entry


def byte_letters() -> list[str]:
    """The printable stand-ins of the 256 bytes: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordMachine:
    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.letters = byte_letters()
        self.table: dict[str, int] = {}

    def compile(self, word: str) -> int:
        """Tokens of a pre-token: merge the pair of lowest rank until none is left."""
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end
        rank = self.rank.get
        far = len(self.rank)
        ranks = [rank(p, far) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == far:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), far)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), far)
        return len(parts)

    def count(self, word: str) -> int:
        found = self.table.get(word)
        if found is None:
            if len(self.table) >= TABLE:
                self.table.clear()
            if len(word) > 400:
                return self.compile_long(word)
            found = self.table[word] = self.compile(word)
        return found

    def compile_long(self, word: str) -> int:
        """As ``compile``, with a heap, for words of any length."""
        import heapq

        parts: list[str | None] = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def push(i: int) -> None:
            j = right[i]
            if j < n and (r := self.rank.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return sum(p is not None for p in parts)


class Counter:
    """Both machines of one tokenizer file; ``count(texts)`` gives token counts."""

    def __init__(self, spec: dict) -> None:
        if spec["model"]["type"] != "BPE" or not spec["model"].get("end_of_word_suffix"):
            raise ValueError("a BPE model with word ends is needed")
        self.splitter, self.words = Splitter(), WordMachine(spec)
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    @staticmethod
    def normalise(text: str) -> str:
        """NFC and lower case; a final sigma is lowered like any other, as letter by letter. Spaces stay one class."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def count(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owners: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if self.special is not None and "<|" in text:
                parts = self.special.split(text)
                total[k] += len(parts) - 1
            else:
                parts = [text]
            for p in parts:
                pieces.append(p := self.normalise(p))
                owners.append(k)
                size += len(p) + 1
            if size >= BATCH_CHARS:
                self._run(pieces, owners, total)
                pieces, owners, size = [], [], 0
        if pieces:
            self._run(pieces, owners, total)
        return total

    def _run(self, pieces: list[str], owners: list[int], total: np.ndarray) -> None:
        joined = "\n".join(pieces) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        flags, classes = self.splitter.starts(codes)
        first = np.flatnonzero(flags)
        if not len(first):
            return
        # a pre-token ends where the next starts, or at the first space after its start
        spaces = np.flatnonzero(classes == SPACE)
        ends = np.minimum(np.append(first[1:], len(codes)), spaces[np.searchsorted(spaces, first)])
        known = self.words.table.get
        count = self.words.count
        emitted = np.fromiter(((c if (c := known(w := joined[a:b])) is not None else count(w)) for a, b in zip(first.tolist(), ends.tolist())), np.int64, len(first))
        borders = np.cumsum([len(p) + 1 for p in pieces])
        piece = np.searchsorted(borders, first, side="right")
        np.add.at(total, np.asarray(owners)[piece], emitted)


_LOADED: dict[str, Counter] = {}


def counter(spec_json: str) -> Counter:
    """One counter for each worker process and tokenizer."""
    if spec_json not in _LOADED:
        _LOADED[spec_json] = Counter(json.loads(spec_json))
    return _LOADED[spec_json]


def load_spec(path: str) -> str:
    """The parts of a tokenizer file that counting needs; a vocabulary of fixed size, read on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    return json.dumps({"added_tokens": spec["added_tokens"], "model": {"type": model["type"], "end_of_word_suffix": model.get("end_of_word_suffix"), "merges": model["merges"]}})


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. The tokenizer's merges travel as one broadcast."""
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(path))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = counter(spec.value)
        for s in batches:
            yield pd.Series(run.count(s.tolist()))

    t = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), tokens(t).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return count_tokens(docs, path)
