"""LM scoring with a weighted backoff automaton.

Counts of words and n-grams cover all training documents and stay distributed tables. An
n-gram is kept from LEAST occurrences on, at any corpus size. What is kept of an order has all
its shorter n-grams kept, so longer ones are only counted where those are.

States are the kept n-grams that begin another one. An arc carries a discounted
log-probability; a state without an arc for the next token passes its failure arc,
which carries the backoff weight, to the state of the next shorter history, down to
the smoothed word frequencies.

Texts are read, cut into words and numbered once, into blocks of some hundred thousand tokens that are
staged: one row holds the numbers of a block's tokens and the hash of each of its words. Blocks then ask,
by shuffles, for what their texts need of the automaton. A request holds the different n-grams of a block
whose hashes fall into one part of the hash range, sorted, with what the block's training texts add to them;
a part adds up the requests for it and answers each in its order. So come the counts of words and word
pairs, then by order those of longer n-grams and the failure weights. A weight needs sums over the kept n-grams that its
history begins; of the blocks that hold an n-gram the first one is told to speak for it, so these sums travel like
counts. Each text is then traversed with the arcs and failure arcs of its block, all its tokens side by side: the
states that a token meets are its histories, from the longest down to the first with an arc.

A hot n-gram costs a block one entry, whatever its count; nothing is broadcast or collected. A text of
more than a block is cut into pieces that repeat their histories; their scores are added up.

Words and n-grams go by 64-bit hashes: of a billion, 0.03 pairs are expected to share one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import dropped, fold, keyed, shown_id, staged, table

#: Tokens of a block, about, and different n-grams asked of a part; they bound what a Python worker holds.
BLOCK_TOKENS, PART_KEYS = 400_000, 2_000_000
#: Occurrences from which an n-gram is kept.
LEAST = 2
DISCOUNT = 0.75
#: The end token and the start, a history only; no word holds a newline. A word number takes 21 bits.
END, START, BITS = b"\n", b"\n\n", 21
_SEED = 42
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
_START_KEY = np.uint64(xxhash.xxh64_intdigest(START, _SEED))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BLOCK = (
    "block long, doc binary, tag binary, place binary, sizes binary, known binary, learns binary, shows binary, codes binary, words binary, "
    "tokens long, learned long, learners long"
)


def _packed(values: np.ndarray) -> bytes:
    """An array's bytes, first bytes first, compressed."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _joined(hist: np.ndarray, low: np.ndarray) -> np.ndarray:
    """xxhash64 of two longs: the key of an n-gram from those of the n-grams without its last and its first word."""
    value = np.full(len(hist), _SEED, np.uint64)
    for part in (hist, low):
        value = value + (_P5 + np.uint64(8)) ^ _turned(part * _P2, 31) * _P1
        value = _turned(value, 27) * _P1 + _P4
        value = (value ^ value >> np.uint64(33)) * _P2
        value = (value ^ value >> np.uint64(29)) * _P3
        value = value ^ value >> np.uint64(32)
    return value


def _pieces(text: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """A text, `size` bytes of it and the word there at a time, and whether it ends there."""
    start = 0
    while len(text) - start > size:
        end = _SPACE.search(text, start + size)
        stop = end.start() if end else len(text)
        yield text[start:stop], False
        start = stop
    yield text[start:], True


def _coded(texts: list[bytes], histories: list[list[bytes]], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all pieces of text, each after its history and before an end if it has one; sizes of the pieces; the words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    coded = lists.flatten().dictionary_encode()
    words, found = coded.dictionary.view(pa.binary()).to_pylist(), coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    if b"" in words:  # beside white space at the ends of a text
        some = found != words.index(b"")
        owner, found = owner[some], found[some]
    counts, known = np.bincount(owner, minlength=len(texts)), np.array([len(h) for h in histories])
    sizes = known + counts + ends
    starts = np.cumsum(sizes) - sizes
    codes = np.full(sizes.sum(), len(words), np.int32)  # START
    codes[np.arange(len(found)) + (starts + known - np.cumsum(counts) + counts)[owner]] = found
    codes[(starts + sizes - 1)[ends]] = len(words) + 1
    words += [START, END]
    later = [i for i, history in enumerate(histories) if history != [START]]
    if later:
        number = {w: i for i, w in enumerate(words)}
        for i in later:
            codes[starts[i] : starts[i] + known[i]] = [number.setdefault(w, len(number)) for w in histories[i]]
        words = list(number)
    return codes, sizes, words


def _thinned(codes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 1 by falling frequency for words that occur again in the block, 0 for others; hashes in that order, then of the others as they come."""
    often = np.bincount(codes, minlength=len(hashes))
    again = np.flatnonzero(often > 1)
    again = again[np.argsort(-often[again], kind="stable")]
    rank = np.zeros(len(hashes), np.int32)
    rank[again] = np.arange(1, len(again) + 1)
    thin = rank[codes]
    return thin, np.concatenate([hashes[again], hashes[codes[thin == 0]]])


def _blocks(order: int, most: int):
    """Blocks of texts; a piece of a text begins with the history of its first token, which is known from the piece before."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = block = TaskContext.get().partitionId() << 40
        pieces: list[tuple] = []
        held, most_bytes = 0, 6 * most

        def row() -> pa.RecordBatch:
            nonlocal pieces, held, block
            texts, histories, ends, *rest = zip(*pieces, strict=True)
            codes, sizes, words = _coded(list(texts), list(histories), np.array(ends))
            docs, tags, places, learns, shows = (np.array(c, np.int64) for c in rest)
            known = np.array([len(h) for h in histories])
            hashes = np.array([xxhash.xxh64_intdigest(w, _SEED) for w in words], np.uint64)
            packed = [_packed(c) for c in (docs, tags, places, sizes, known, learns, shows, *_thinned(codes, hashes))]
            counts = [len(codes), int((sizes - known)[learns > 0].sum()), int((learns * np.array(ends)).sum())]
            names = [field.split()[0] for field in _BLOCK.split(", ")]
            columns = [pa.array([block], pa.int64()), *[pa.array([c], pa.binary()) for c in packed], *[pa.array([c], pa.int64()) for c in counts]]
            pieces, held, block = [], 0, block + 1
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            docs, tags, learns, shows = (batch.column(c).to_pylist() for c in ("doc", "tag", "learns", "shows"))
            for i, text in enumerate(batch.column("text")):
                history = [START]
                for piece, ends in _pieces(text.as_buffer().to_pybytes() if text.is_valid else b"", most_bytes):
                    pieces.append((piece, history, ends, docs[i], tags[i], place, learns[i], shows[i]))
                    held += len(piece) + 6
                    if not ends:
                        history = (history + piece.lower().split())[-max(1, order - 1) :]
                    if held >= most_bytes:
                        yield row()
                place += 1
        if pieces:
            yield row()

    return of


def _numbered(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys at the wanted places, sorted, and the number of each place's among them, -1 elsewhere."""
    places = np.flatnonzero(wanted)
    held = keys[places]
    by = np.argsort(held)
    held = held[by]
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    numbers = np.full(len(keys), -1)
    numbers[places[by]] = np.cumsum(new) - 1
    return held[new], numbers


class _Grams:
    """The n-grams of one order in a block: different keys, sorted; the number of the one that starts at each token (-1: none is asked
    for); whether that one ends in a token of a training text that no other piece holds; and, if known, the counts of the keys and
    whether this block is the one to speak for them."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray, learned: np.ndarray, n: np.ndarray | None, speaks: np.ndarray | None, least: int):
        self.keys, self.numbers, self.learned, self.n, self.speaks = keys, numbers, learned, n, speaks
        self.kept = n is not None and np.append(n >= least, False)[numbers]

    def at(self, values: np.ndarray) -> np.ndarray:
        """Values of the keys, at the places; zero where none is asked for."""
        return np.append(values, 0)[self.numbers]


class _Block:
    def __init__(self, row: dict):
        self.row = row
        sizes, known = self.held("sizes"), self.held("known")
        self.words, self.codes = self.held("words", np.uint64), self.held("codes", np.int32) - 1
        once = np.flatnonzero(self.codes < 0)
        self.codes[once] = np.arange(len(self.words) - len(once), len(self.words))
        self.rows = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        self.new = np.arange(len(self.codes)) - starts[self.rows] >= known[self.rows]
        self.learned = self.new & (self.held("learns") > 0)[self.rows]

    def held(self, name: str, kind: type = np.int64) -> np.ndarray:
        return _unpacked(self.row[name], kind)

    def answer(self, name: str, size: int, kind: type) -> np.ndarray | None:
        """What the parts have answered for an order, in the order of its keys; None if not asked."""
        if name not in self.row:
            return None
        found = [_unpacked(a["found"], kind) for a in self.row[name] or () if a["size"] == size]
        return np.concatenate([np.zeros(0, kind), *found])

    def grams(self, order: int, least: int, learners: int) -> list[_Grams]:
        """N-grams up to an order; longer than two only those whose shorter ones are kept."""
        found: list[_Grams] = []
        keys = self.words[self.codes]
        for size in range(1, order + 1):
            wanted = np.ones(len(keys), bool)
            if size > 1:
                keys = _joined(keys[:-1], keys[1:])
                wanted = self.rows[: len(keys)] == self.rows[size - 1 :]
            if size > 2:
                wanted &= found[-1].kept[:-1] & found[-1].kept[1:]
            different, numbers = _numbered(keys, wanted)
            told = self.answer("counts" if size < 3 else f"counts{size}", size, np.int64)
            n, speaks = (None, None) if told is None else (told >> 1, told & 1 > 0)
            if size == 1 and n is not None:
                n = np.where(different == _START_KEY, learners, n)
            found.append(_Grams(different, numbers, self.learned[size - 1 :] & (numbers >= 0), n, speaks, least))
        return found


def _asked(block: _Block, grams: list[_Grams], size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the histories of an order, whether a block asks for their weights, and the places of the arcs that it speaks for.

    It asks for histories of those arcs, and for others that a token of it fails at, unless too few of their
    occurrences are left outside the failures of its training texts to begin a kept n-gram: those have no weight.
    """
    hist, longer = grams[size - 1], grams[size]
    last = np.zeros(len(longer.keys), np.int64)
    held = np.flatnonzero(longer.numbers >= 0)
    last[longer.numbers[held]] = held  # any one place of each
    places = last[longer.speaks & (longer.n >= least)]
    states = hist.numbers[: len(longer.numbers)]
    failed = (block.rows[: len(states)] == block.rows[size:]) & ~longer.kept & (states >= 0)
    fails = np.bincount(states[failed], minlength=len(hist.keys))
    lost = np.bincount(states[failed & block.learned[size:]], minlength=len(hist.keys))
    asked = (fails > 0) & (hist.n - lost >= least)
    asked[states[places]] = True
    return asked & (hist.n >= least), places


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(batch.slice(i, 1).to_pylist()[0])


def _requests(blocks: DataFrame, asked: Callable[[_Block], Iterator[tuple]], parts: int) -> DataFrame:
    """Rows of size, part, block and three packed arrays: steps between an order's sorted keys, one number for each key, and values."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["size", "part", "block", "keys", "each", "values"]
        for block in _each(batches):
            for size, keys, each, values in asked(block):
                part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                ends = np.append(starts, len(part))[1:]
                upto = np.append(0, np.cumsum(each, dtype=np.int64)) if len(values) else np.zeros(len(keys) + 1, np.int64)
                cut = [[], [], []]
                for a, b in zip(starts, ends, strict=True):
                    for c, piece in zip(cut, (np.diff(keys[a:b], prepend=np.uint64(0)), each[a:b], values[upto[a] : upto[b]]), strict=True):
                        c.append(_packed(piece))
                rows = [pa.array(np.full(len(ends), size, np.int32)), pa.array(part[starts].astype(np.int64)), pa.array(np.full(len(ends), block.row["block"], np.int64))]
                yield pa.RecordBatch.from_arrays(rows + [pa.array(c, pa.binary()) for c in cut], names)

    return blocks.mapInArrow(of, "size int, part long, block long, keys binary, each binary, values binary")


def _answered(requests: DataFrame, answer: Callable[..., tuple[np.ndarray, int]], label: str) -> DataFrame:
    """Per block the answers to its requests, by order and part; `answer` gets the number of the key of each entry, how many keys there are, and the requests."""

    def of(requests: pa.Table) -> pa.Table:
        requests = requests.sort_by("block")
        asked = [np.cumsum(_unpacked(k, np.uint64)) for k in requests["keys"].to_pylist()]
        ends = np.cumsum([len(k) for k in asked])
        keys, numbers = _numbered(np.concatenate(asked), np.ones(ends[-1], bool))
        found, types = answer(numbers, len(keys), requests)
        cut = [_packed(c) for c in np.split(found, ends[:-1])]
        rest = [pa.array(cut, pa.binary()), pa.array([types] + [0] * (len(cut) - 1), pa.int64())]
        return pa.table([*(requests[c] for c in ("size", "part", "block")), *rest], ["size", "part", "block", "found", "types"])

    found = requests.groupBy("size", "part").applyInArrow(of, "size int, part long, block long, found binary, types long")
    ordered = F.array_sort(F.collect_list(F.struct("size", "part", "found")))
    types = F.sum(F.when(F.col("size") == 1, F.col("types")).otherwise(0)).alias("types")
    return staged(found.groupBy("block").agg(ordered.alias("found"), types), label)


def _joint(requests: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([_unpacked(c, kind) for c in requests[name].to_pylist()])


def _counts(sizes: range, least: int, learners: int):
    """Asks for the counts of n-grams of some orders."""

    def of(block: _Block) -> Iterator[tuple]:
        for size, grams in enumerate(block.grams(sizes[-1], least, learners), 1):
            if size in sizes:
                yield size, grams.keys, np.bincount(grams.numbers[grams.learned], minlength=len(grams.keys)).astype(np.uint32), np.zeros(0)

    return of


def _count(numbers: np.ndarray, size: int, requests: pa.Table) -> tuple[np.ndarray, int]:
    """Twice the count of each entry's key, plus one for the first entry that counts some: its block speaks for the key."""
    each = _joint(requests, "each", np.uint32)
    n = np.bincount(numbers, each, size).astype(np.int64)
    some = np.flatnonzero(each)[::-1]
    first = np.full(size, -1)
    first[numbers[some]] = some  # the last one written stays
    return 2 * n[numbers] + (first[numbers] == np.arange(len(numbers))), int(np.count_nonzero(n))


def _chances(grams: list[_Grams], floor: float) -> list[np.ndarray]:
    """Per order the probabilities of arcs, at the places of kept n-grams; of words, kept or not, their smoothed frequencies."""
    out = [(grams[0].at(grams[0].n) + 0.5) / floor]
    for shorter, longer in zip(grams, grams[1:], strict=False):
        totals = shorter.at(shorter.n)[: len(longer.numbers)]
        out.append(np.divide(longer.at(longer.n) - DISCOUNT, totals, out=np.ones(len(totals)), where=longer.kept))
    return out


def _weights(size: int, least: int, learners: int, floor: float):
    """Asks for the failure weights of histories of an order, with what the arcs that this block speaks for have of the probability,
    and would have without them."""

    def of(block: _Block) -> Iterator[tuple]:
        grams = block.grams(size + 1, least, learners)
        chances, hist = _chances(grams, floor), grams[-2]
        asked, places = _asked(block, grams, size, least)
        states = hist.numbers[places]
        own = np.bincount(states, chances[-1][places], len(hist.keys))[asked]
        lower = np.bincount(states, chances[-2][places + 1], len(hist.keys))[asked]
        some = own > 0
        yield size, hist.keys[asked], 2 * some.astype(np.uint8), np.stack([own[some], lower[some]], 1).ravel()

    return of


def _weight(numbers: np.ndarray, size: int, requests: pa.Table) -> tuple[np.ndarray, int]:
    some, values = _joint(requests, "each", np.uint8) > 0, _joint(requests, "values", np.float64)
    own, lower = (np.bincount(numbers[some], values[k::2], size) for k in (0, 1))
    left = [np.log10(np.maximum(1 - c, 1e-12)) for c in (own, lower)]
    weight = np.where(own > 0, left[0] - left[1], 0.0)
    return (weight.view(np.int64) & ~0xFFFF).view(np.float64)[numbers], 0  # 36 binary digits: the others cost disk


def _traversed(order: int, least: int, learners: int, floor: float):
    """Scores of pieces of texts: each token takes the arc of its longest history that has one, after the failure arcs of the longer ones."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "tag", "place", "n_tokens", "n_known", "base_score", "score"]
        for block in _each(batches):
            grams = block.grams(order, least, learners)
            chances = [np.log10(c) for c in _chances(grams, floor)]
            score = chances[0].copy()
            for size in range(2, order + 1):
                hist, longer = grams[size - 2], grams[size - 1]
                weight = np.zeros(len(hist.keys))
                weight[_asked(block, grams, size - 1, least)[0]] = block.answer(f"weights{size - 1}", size - 1, np.float64)
                last = score[size - 1 :]  # the tokens that an n-gram may end in
                inside = block.rows[: len(last)] == block.rows[size - 1 :]
                failed = last + hist.at(weight)[: len(last)]
                score[size - 1 :] = np.where(longer.kept, chances[size - 1], np.where(inside, failed, last))
            new, rows, n = block.new, len(block.held("doc")), grams[0].at(grams[0].n)
            owner = block.rows[new]
            sums = [np.bincount(owner, minlength=rows), np.bincount(owner[n[new] > 0], minlength=rows)]
            sums += [np.bincount(owner, c[new], rows) for c in (chances[0], score)]
            shown = block.held("shows") > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[shown]) for c in [*(block.held(c) for c in names[:3]), *sums]], names)

    return of


class Automaton:
    """Arcs and failure arcs of the kept n-grams; states are numbers, 0 is the empty history. The definition that sums of values are tested with."""

    def __init__(self, bottom: list[float], counts: list[int], ngrams: list[tuple[np.ndarray, np.ndarray]], starts: int):
        """bottom: log-probability of each word; counts: of each word; ngrams: keys and counts from order 2 up."""
        mask = (1 << BITS) - 1
        start = len(bottom)
        prob: dict[tuple[int, ...], float] = {(w,): 10**p for w, p in enumerate(bottom)}
        seen: dict[tuple[int, ...], int] = {(w,): n for w, n in enumerate(counts)} | {(start,): starts}
        history: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        for order, (keys, numbers) in enumerate(ngrams, 2):
            for key, n in zip(keys.tolist(), numbers.tolist(), strict=True):
                gram = tuple(key >> BITS * k & mask for k in range(order - 1, -1, -1))
                seen[gram] = n
                history.setdefault(gram[:-1], []).append(gram)
        self.state = {(): 0} | {h: i for i, h in enumerate(history, 1)}
        self.failure, self.weight = [0] * len(self.state), [0.0] * len(self.state)
        self.arcs: dict[int, tuple[float, int]] = {}
        for h in sorted(history, key=len):  # shorter histories first: longer ones back off to them
            total, grams = seen[h], history[h]
            for gram in grams:
                prob[gram] = max(seen[gram] - DISCOUNT, 0.0) / total
            own = sum(prob[gram] for gram in grams)
            lower = sum(self._lower(prob, gram[1:]) for gram in grams)
            at = self.state[h]
            self.weight[at] = log10(max(1 - own, 1e-12) / max(1 - lower, 1e-12))
            self.failure[at] = self._longest(h[1:])
            for gram in grams:
                self.arcs[at << BITS | gram[-1]] = (log10(prob[gram]), self._longest(gram))
        self.bottom = bottom
        self.after = [self.state.get((w,), 0) for w in range(len(bottom))]
        self.start = self.state.get((start,), 0)

    def _lower(self, prob: dict[tuple[int, ...], float], gram: tuple[int, ...]) -> float:
        """Probability of a gram's last word given the words before it, by backing off."""
        weight = 0.0
        while gram not in prob:
            at = self.state.get(gram[:-1])
            weight += self.weight[at] if at else 0.0
            gram = gram[1:]
        return prob[gram] * 10**weight

    def _longest(self, gram: tuple[int, ...]) -> int:
        while gram not in self.state:
            gram = gram[1:]
        return self.state[gram]

    def tables(self) -> tuple:
        return self.arcs, self.failure, self.weight, self.bottom, self.after, self.start


def _traverse(ids: list[int], tables: tuple) -> float:
    """Log-probability of a sequence of word numbers; unknown ones (-1) count for their failure arcs only."""
    arcs, failure, weight, bottom, after, state = tables
    get, total = arcs.get, 0.0
    for word in ids:
        if word < 0:
            while state:
                total += weight[state]
                state = failure[state]
            continue
        while True:
            arc = get(state << BITS | word) if state else None
            if arc:
                total += arc[0]
                state = arc[1]
                break
            if not state:
                total += bottom[word]
                state = after[word]
                break
            total += weight[state]
            state = failure[state]
    return total


def lm_scores(
    docs: DataFrame, train: DataFrame | Column, order: int = 3, word_share: float | None = None, ngram_share: float | None = None, least: int = LEAST,
    block_tokens: int = BLOCK_TOKENS, part_keys: int = PART_KEYS,
) -> DataFrame:
    """doc, tag, n_tokens, n_known, train_tokens, base_score, score for keyed rows, by a model of the keyed rows `train`,
    a table or a condition on `docs`; with a condition, no text is read twice.

    Tokens are the words of a text after lower-casing A-Z, then one end. base_score
    takes add-0.5 word frequencies, score the automaton that backs off to them, with all n-grams
    that occur `least` times in `train` (2 or more). Null and empty texts are one end token. Without training
    rows every token has probability 1. Repeated rows get equal results. `block_tokens` and `part_keys` say how the work is
    cut and change no score; nor do the shares, which once chose what is broadcast: nothing is any more.
    """
    least, no, yes = max(2, least), F.lit(0).cast("long"), F.lit(1).cast("long")
    if isinstance(train, DataFrame):
        texts = docs.select("doc", "tag", "text", no.alias("learns"), yes.alias("shows"))
        texts = texts.unionByName(train.select("doc", "tag", "text", yes.alias("learns"), no.alias("shows")))
    else:
        texts = docs.select("doc", "tag", "text", F.coalesce(train, F.lit(False)).cast("long").alias("learns"), yes.alias("shows"))
    blocks = staged(texts.mapInArrow(_blocks(order, block_tokens), _BLOCK), "lm-blocks")
    sums = [F.coalesce(F.sum(c), no) for c in ("tokens", "learned", "learners")]
    tokens, total, learners = blocks.agg(*sums).first()
    parts = max(1, tokens // part_keys)

    def told(known: DataFrame, found: DataFrame, name: str) -> DataFrame:
        return known.join(found.select("block", F.col("found").alias(name)).hint("merge"), "block", "left")

    def exchanged(known: DataFrame, asked: Callable, answer: Callable, label: str) -> DataFrame:
        if known is blocks:
            return _answered(_requests(known, asked, parts), answer, label)
        requests = staged(_requests(known, asked, parts), "lm-requests")  # the shuffle of the blocks is gone when that of the requests begins
        answers = _answered(requests, answer, label)
        dropped(requests)
        return answers

    found = exchanged(blocks, _counts(range(1, min(order, 2) + 1), least, learners), _count, "lm-counts")
    types = found.agg(F.coalesce(F.sum("types"), no)).first()[0]
    floor = 0.5 * (types + 1) + total
    known = told(blocks, found, "counts")
    for size in range(3, order + 1):
        known = told(known, exchanged(known, _counts(range(size, size + 1), least, learners), _count, "lm-counts"), f"counts{size}")
    weights = [exchanged(known, _weights(size, least, learners, floor), _weight, "lm-weights") for size in range(1, order)]
    for size, found in enumerate(weights, 1):
        known = told(known, found, f"weights{size}")
    shape = "doc long, tag long, place long, n_tokens long, n_known long, base_score double, score double"
    pieces = known.mapInArrow(_traversed(order, least, learners, floor), shape)
    names = ["n_tokens", "n_known", "base_score", "score"]
    out = pieces.groupBy("doc", "tag", "place").agg(*[F.sum(c).alias(c) for c in names])
    return out.select("doc", "tag", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = fold(shown_id(), 5) == 1
    return lm_scores(keyed(documents), ~held_out).select(
        shown_id().alias("doc_id"), held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
