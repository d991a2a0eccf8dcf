"""N-best segmentations into the pieces of a SentencePiece model, the model's own encoding, and back.

All ways to write a text as pieces form a lattice. A forward Viterbi pass gives the best score from the
start to every place; for a search from the end backwards that is the exact cost of what is still to go,
so A-star meets complete segmentations in the order of their scores and expands nothing it need not. Of the
pieces that end at a place the search takes the best and comes back for the next only once that is used.

A model made by merges has no probabilities: its scores are the ranks of the merges and cannot be summed.
So pieces are scored by log probabilities over the rows given: every text is encoded by the model's own rule,
and a grouped aggregate counts the pieces. The own encoding is returned beside the n best.

No piece reaches over the beginning of a word, and none holds a letter beside a full stop or a line break, so a
text's lattice is a chain of the lattices of such units. A task looks up the different words of many texts, has the
units of each by number, and searches a unit once while it remembers a word with it, the new ones of many texts
together: from the units' ends backwards every place keeps its best ways on, which gives what the search above gives
one unit at a time. That search stays for long units and for scores whose sums are not exact. The chain's n best
follow from a second best-first search over how far each unit departs from its best. n - 1 units at most can depart,
those whose second best way costs least: only of them are all n ways made. Results lie on end in flat arrays, from
which the units of many texts are gathered together.
"""

from __future__ import annotations

import collections
import functools
import heapq
import itertools
import operator
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tablemill.llm.store import give_back, lean

SPACE = "▁"
N_BEST = 4
CACHE = 100_000  # words of a generation; two are remembered
NEAR, COMMON = 4, 128  # lengths below, and first characters, for which a trie has a table
HELD = 1 << 20  # ids that a task holds before it gives rows away
AHEAD = 1 << 20  # characters of texts whose new words are searched together
COUNTED = 1 << 23  # characters of texts whose words are counted together
ABREAST = 20_000  # units that are searched at once
LONG = 64  # characters of a unit beyond which it is searched for itself
NONE = 1 << 62  # a way that is not there; those that are stay below
GRAIN = 2.0**20  # log probabilities are multiples of its inverse, so that sums are exact and ties are ties

Path = tuple[float, tuple[int, ...]]

_lean = functools.partial(lean, "pieces")


class Remembered:
    """Results by word, in two generations: what is asked for again outlives what is not."""

    def __init__(self, make):
        self.make, self.new, self.old = make, {}, {}

    def all(self, words: list[str]) -> list:
        """The results of words, made for those that are not remembered."""
        if len(self.new) >= CACHE:
            self.new, self.old = {}, self.new
        new = self.new
        lost = [w for w in dict.fromkeys(words) if w not in new]
        if lost:
            again = {w: self.old[w] for w in lost if w in self.old}
            new.update(again)
            fresh = [w for w in lost if w not in again]
            new.update(zip(fresh, self.make(fresh), strict=True))
        return [new[w] for w in words]


class Words:
    """Results of words by number, on end. Of many, those that were asked for most are remembered."""

    def __init__(self, make):
        self.make = make
        self.begin([], [], np.empty(0, dtype=np.int64), None)

    def begin(self, words: list[str], cut: list, hits: np.ndarray, runs: list | None) -> None:
        self.number, self.cut, self.hits, self.runs = collections.defaultdict(None, zip(words, itertools.count())), cut, hits, runs
        self.number.default_factory = self.number.__len__

    def all(self, words: list[str], times: np.ndarray | None = None) -> np.ndarray:
        """The numbers of words asked for some ``times``, whose results are made where they are not remembered."""
        if self.full():
            self.forget()
        old = len(self.cut)
        found = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        fresh = list(itertools.islice(self.number, old, None))
        if fresh or self.runs is None:
            try:
                cut, *runs = self.make(fresh)
            except BaseException:
                for w in fresh:
                    del self.number[w]
                raise
            self.cut += cut
            self.runs = runs if self.runs is None else [tuple(map(np.concatenate, zip(a, b, strict=True))) for a, b in zip(self.runs, runs, strict=True)]
            self.hits = np.concatenate([self.hits, np.zeros(len(fresh), dtype=np.int64)])
        self.hits += np.bincount(found, times, minlength=len(self.hits)).astype(np.int64)
        return found

    def full(self) -> bool:
        return len(self.cut) >= 2 * CACHE

    def forget(self) -> None:
        self.keep(np.sort(np.argsort(-self.hits, kind="stable")[:CACHE]))

    def keep(self, keep: np.ndarray) -> None:
        words = list(self.number)
        places = keep.tolist()
        runs = [(values[_gathered(sizes, keep)], sizes[keep]) for values, sizes in self.runs]
        self.begin([words[i] for i in places], [self.cut[i] for i in places], self.hits[keep] // 2, runs)

    def of(self, part: int, found: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """For each text the results of its words; ``ends`` count words, from 0."""
        values, sizes = self.runs[part]
        values = values[_gathered(sizes, found)]
        bounds = np.concatenate(([0], np.cumsum(sizes[found])))[ends].tolist()
        return [values[i:j] for i, j in itertools.pairwise(bounds)]


class Units(Words):
    """Results of units, which stay as long as a word that has them."""

    def full(self) -> bool:
        return False


class Chains(Words):
    """Words as the numbers of their units."""

    def __init__(self, make, units_: Units):
        self.units = units_
        super().__init__(make)

    def full(self) -> bool:
        return super().full() or len(self.units.cut) >= 4 * CACHE

    def forget(self) -> None:
        super().forget()
        [(numbers, many)] = self.runs
        used, numbers = np.unique(numbers, return_inverse=True)
        self.units.keep(used)
        self.runs = [(numbers, many)]


class Pieces:
    """The pieces of a model, and the search for segmentations by their scores: the model's if none are given."""

    def __init__(self, path: str, scores: list[float] | None = None):
        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores = [model.get_score(i) for i in range(model.get_piece_size())] if scores is None else scores
        self.texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if model.is_byte(i)}
        self.names = {i: b for b, i in self.bytes.items()}
        plain = [i for i in range(len(self.texts)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.texts[i]: i for i in plain}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece reaches over the beginning of a word")
        self.signs = frozenset(apart(self.ids))
        self.unit = units(self.ids)
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.words = {}
        self.plain = by_words(path)
        self.raw = pa.array([bytes([self.names[i]]) if i in self.names else t.replace(SPACE, " ").encode() for i, t in enumerate(self.texts)], pa.binary())
        self.lengths = np.array([1 if i in self.names or i == self.unknown else len(t) for i, t in enumerate(self.texts)])
        exact = np.asarray(self.scores, dtype=np.float64) * GRAIN
        # sums of such scores are exact in integers, as they are in floating point
        whole = np.isfinite(exact).all() and (exact == np.rint(exact)).all() and np.abs(exact).max(initial=0) < 1 << 62
        self.costs = -exact.astype(np.int64) if whole else None
        self.trie = Trie(self.ids) if whole else None

    def own(self, text: str) -> np.ndarray:
        """The model's own ids of a whole text."""
        return np.array(self.model.encode(text, num_threads=1), dtype="<i4")

    def own_of_words(self, words: list[str]) -> list[bytes]:
        """The model's own ids of words of normalised texts; only where ``plain`` is a model."""
        return _slices(*self.own_on_end(words))

    def own_on_end(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`own_of_words`, on end, and how many each word has."""
        ids = self.plain.encode(words, num_threads=1)
        return _flat(ids), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))

    def bare(self, text: str) -> list[str]:
        """The words of a text, each without the space that every word of a normalised text begins with."""
        whole = normalised(text)
        return [w[1:] for w in self.word.findall(whole)] if SPACE * 2 in whole else whole.split(SPACE)[1:]

    def own_counts(self, texts) -> np.ndarray:
        """How often the model's own encodings of texts have each id."""
        seen = np.zeros(len(self.texts), dtype=np.int64)
        if self.plain is None:
            for text in texts:
                seen += np.bincount(self.own(text or ""), minlength=len(seen))
            return seen
        for some in _some((text or "" for text in texts), COUNTED):
            words, times = self.different(some)[:2]
            ids, sizes = self.own_on_end([SPACE + w for w in words])
            seen += np.bincount(ids, np.repeat(times, sizes), minlength=len(seen)).astype(np.int64)
        return seen

    def different(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The words of texts, bare; how often each occurs; and all texts' words in order by number, with how many each has.

        A word of a text that cannot just be split at spaces may be listed several times.
        """
        odd = [not t or t[0] == " " or "  " in t or SPACE in t for t in texts]
        try:
            lists = pc.split_pattern(pa.array(itertools.compress(texts, map(operator.not_, odd)), pa.string()), " ")
        except UnicodeEncodeError:  # half of a surrogate pair
            odd = [True] * len(texts)
            lists = pa.array([], pa.list_(pa.string()))
        coded = lists.flatten().dictionary_encode()
        number, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rest = [self.bare(t) for t in itertools.compress(texts, odd)]
        more = list(itertools.chain.from_iterable(rest))
        times = np.concatenate([np.bincount(number, minlength=len(words)), np.ones(len(more), dtype=np.int64)])
        number = np.concatenate([number, np.arange(len(words), len(words) + len(more))])
        sizes = np.concatenate([lists.value_lengths().to_numpy(), np.fromiter(map(len, rest), dtype=np.int64, count=len(rest))])
        if rest:
            # texts in their order again
            place = np.argsort(np.argsort(odd, kind="stable"))
            number, sizes = number[_gathered(sizes, place)], sizes[place]
        return words + more, times, number, sizes

    def edges(self, word: str) -> tuple[list[list], list[float]]:
        """For each place the pieces that end there, as (score, start, ids), and the best score from the start to it."""
        ends, forward = [[]], [0.0]
        known, scores = self.ids, self.scores
        for end in range(1, len(word) + 1):
            here = []
            for start in range(max(0, end - self.longest), end):
                piece = known.get(word[start:end])
                if piece is not None:
                    here.append((scores[piece], start, (piece,)))
            if word[end - 1] not in known:
                # a character that is no piece is spelt in bytes
                data = word[end - 1].encode(errors="replace")
                spelt = tuple(self.bytes.get(b, self.unknown) for b in data)
                here.append((sum(scores[i] for i in spelt), end - 1, spelt))
            ends.append(here)
            forward.append(max(score + forward[start] for score, start, _ in here))
        return ends, forward

    def search(self, word: str, n: int) -> list[Path]:
        """The ``n`` best segmentations of a word: scores and ids, best first, ties to smaller ids."""
        ends, forward = self.edges(word)
        ordered: list[list | None] = [None] * len(ends)
        # A place is left at most n times, for its n best ways to the word's end: the heap gives them in order,
        # equal totals from right to left and then by the piece that begins there and the rank of what follows it.
        ways: list[list[tuple[float, tuple[int, ...], int, int]]] = [[] for _ in ends]
        ways[-1].append((0.0, (), len(word), 0))
        heap: list[tuple[float, int, int, int, int, int]] = []

        def offer(place: int, rank: int, nth: int) -> None:
            """The ``nth`` best piece that ends at a place, before its way of a rank."""
            pieces_ = ordered[place]
            if pieces_ is None:
                pieces_ = ordered[place] = sorted((-(forward[start] + score), -start, ids[0], score, ids) for score, start, ids in ends[place])
            if nth < len(pieces_):
                ahead, minus, first, _, _ = pieces_[nth]
                heapq.heappush(heap, (ahead - ways[place][rank][0], minus, first, rank, place, nth))

        if word:
            offer(len(word), 0, 0)
        while heap and len(ways[0]) < n:
            _, minus, _, rank, place, nth = heapq.heappop(heap)
            offer(place, rank, nth + 1)
            mine = ways[-minus]
            if len(mine) < n:
                _, _, _, score, ids = ordered[place][nth]
                mine.append((ways[place][rank][0] + score, ids, place, rank))
                if minus:
                    offer(-minus, len(mine) - 1, 0)
        found: list[Path] = []
        for behind, ids, after, rank in ways[0]:
            whole = list(ids)
            while after < len(word):
                _, ids, after, rank = ways[after][rank]
                whole += ids
            found.append((behind, tuple(whole)))
        return found

    def abreast(self, words: list[str], n: int) -> list[tuple]:
        """As :func:`_unit` of each word's :meth:`search`, for many different words of at most ``LONG`` characters.

        A way from a place to the word's end is one integer: its cost, the piece it begins with, and the rank of
        what follows among the ways from there. So the smaller of two is the better, ties to smaller ids.
        """
        if not self.together(n):
            return [_unit(self.search(w, n)) for w in words]
        each, _, total, sizes, ids = self.ways(words, n, n)
        return _units(each, total, sizes, ids)

    def together(self, n: int) -> bool:
        """Whether :meth:`ways` can hold the costs of ``n`` ways."""
        shift = (len(self.texts) << (n - 1).bit_length()).bit_length()
        return self.costs is not None and int(np.abs(self.costs).max()) * 4 * (LONG + 1) < NONE >> shift

    def ways(self, words: list[str], n: int, written: int) -> tuple[np.ndarray, ...]:
        """The ``n`` best ways of words: how many each has, and of all the word and the score; sizes and ids of the first ``written``."""
        ranks = 1 << (n - 1).bit_length()
        shift = (len(self.texts) * ranks).bit_length()
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1  # a word has a place before each character, and its end
        chars = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ahead = np.repeat(starts + sizes, sizes + 1) - np.arange(len(chars))  # characters to the word's end
        at, length, piece = self.trie.walk(chars, ahead)
        cost = self.costs[piece]
        # a character that is no piece is spelt in bytes
        spelt = np.ones(len(chars), dtype=bool)
        spelt[at[length == 1]] = False
        spelt = np.flatnonzero(spelt & (ahead > 0))
        kinds, kind = np.unique(chars[spelt], return_inverse=True)
        spellings = [[self.bytes.get(b, self.unknown) for b in chr(c).encode(errors="replace")] for c in kinds]
        at, length = np.concatenate([at, spelt]), np.concatenate([length, np.ones(len(spelt), dtype=length.dtype)])
        piece = np.concatenate([piece, np.array([s[0] for s in spellings], dtype=np.int64)[kind]])
        cost = np.concatenate([cost, np.array([self.costs[s].sum() for s in spellings], dtype=np.int64)[kind]])

        ways = np.full((ranks, len(chars)), NONE, dtype=np.int64)
        ways[0, ahead == 0] = 0
        step = ahead[at] * (self.longest + 1) + length
        order = _order(step)
        at, to, edge = at[order], (at + length)[order], ((cost << shift) + piece * ranks)[order]
        low = (1 << shift) - 1
        rank = np.arange(ranks)[:, None]
        bounds = np.flatnonzero(np.diff(step[order], prepend=-1, append=-1))
        for i, j in itertools.pairwise(bounds.tolist()):
            more = (ways[:, to[i:j]] & ~low) + edge[i:j] + rank
            ways[:, at[i:j]] = _merged(ways[:, at[i:j]], more)

        # all ways are followed at once, a piece of each at a time
        way, unit = np.nonzero(ways[:n, starts].T < NONE)[::-1]
        total = -(ways[way, starts[unit]] >> shift) / GRAIN
        each = np.bincount(unit, minlength=len(words))
        scored, unit, way = unit, unit[way < written], way[way < written]
        place, path, parts = starts[unit], np.arange(len(unit)), []
        while len(path):
            here = ways[way, place] & low
            parts.append((path, here // ranks, place))
            way, place = here % ranks, place + self.lengths[here // ranks]
            left = ahead[place] > 0
            path, way, place = path[left], way[left], place[left]
        path, ids, place = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = _order(path)
        path, ids, place = path[order], ids[order], place[order]
        # the first byte stands for a character's bytes so far
        several = np.ones(len(ids), dtype=np.int64)
        mine = np.flatnonzero(np.isin(place, spelt))
        mine_kind = kind[np.searchsorted(spelt, place[mine])]
        several[mine] = np.array([len(s) for s in spellings], dtype=np.int64)[mine_kind]
        spread = np.repeat(ids, several).astype("<i4")
        first = np.cumsum(several) - several
        for k, spelling in enumerate(spellings):
            for b, i in enumerate(spelling):
                spread[first[mine[mine_kind == k]] + b] = i
        sizes = np.bincount(path, weights=several, minlength=len(unit)).astype(np.int64)
        return each, scored, total, sizes, spread

    def chains(self, words: list[str], units_: Units) -> tuple[list, tuple]:
        """The numbers of the units of words without their first space."""
        signs, findall = self.signs, self.unit.findall
        cut, many = [], []
        for w in words:
            # a word of letters alone is one unit, a sign behind it another
            if w.isalpha():
                cut.append(SPACE + w)
                many.append(1)
            elif w[-1:] in signs and w[:-1].isalpha():
                cut += SPACE + w[:-1], w[-1]
                many.append(2)
            else:
                some = findall(SPACE + w)
                cut += some
                many.append(len(some))
        return words, (units_.all(cut), np.array(many, dtype=np.int64))

    def made(self, units_: list[str], n: int) -> tuple[list, tuple, tuple, tuple]:
        """Of different units, on end, with their numbers: own ids, best ids and facts."""
        length = np.fromiter(map(len, units_), dtype=np.int64, count=len(units_))
        alone = np.flatnonzero(length > LONG) if self.together(n) else np.arange(len(units_))
        found = [_unit(self.paths_of(units_[i], n)) for i in alone.tolist()]
        facts, ids = [np.array([(gap, score, len(best) // 4) for gap, score, best, _, _ in found], dtype=FACTS)], [b"".join(map(_BEST, found))]
        short = np.argsort(length, kind="stable")[: len(units_) - len(alone)]
        for i in range(0, len(short), ABREAST):
            some = [units_[k] for k in short[i : i + ABREAST].tolist()]
            # what the second best way costs tells where to depart; all ways are made for the few units that do
            each, unit, scores, sizes, best = self.ways(some, min(n, 2), 1)
            first = np.cumsum(each) - each
            fact = np.zeros(len(some), dtype=FACTS)
            fact["gap"], fact["score"], fact["size"] = np.inf, scores[first], sizes
            two = np.flatnonzero(each > 1)
            fact["gap"][two] = scores[first[two]] - scores[first[two] + 1]
            facts.append(fact)
            ids.append(best.tobytes())
        place = np.argsort(np.concatenate([alone, short]))
        facts, ids = np.concatenate(facts), np.frombuffer(b"".join(ids), dtype="<i4")
        ids, facts = ids[_gathered(facts["size"], place)], facts[place]
        # no merge makes what is no piece, so units have their own ids as words do
        own = self.own_on_end(units_) if self.plain is not None else (np.empty(0, dtype="<i4"), np.zeros(len(units_), dtype=np.int64))
        return units_, own, (ids, facts["size"]), (facts, np.ones(len(units_), dtype=np.int64))

    def paths_of(self, unit: str, n: int) -> list[Path]:
        """As :meth:`search`, remembered for :meth:`departures`."""
        found = self.search(unit, n)
        self.kept(n)[2].new[unit] = _arrays(found)
        return found

    def departures(self, units_: list[str], n: int) -> list[list[tuple[float, np.ndarray]]]:
        """All ways of units that have several."""
        short = [u for u in units_ if len(u) <= LONG] if self.together(n) else []
        found = dict(zip(short, map(_paths, self.abreast(short, n) if short else []), strict=True))
        return [found[u] if u in found else _arrays(self.search(u, n)) for u in units_]

    def kept(self, n: int) -> tuple[Chains, Units, Remembered]:
        """What is remembered of words, of their units, and of units that texts depart in."""
        if n not in self.words:
            units_ = Units(lambda fresh: self.made(fresh, n))
            words = Chains(lambda fresh: self.chains(fresh, units_), units_)
            self.words[n] = words, units_, Remembered(lambda asked: self.departures(asked, n))
        return self.words[n]

    def segments(self, texts: list[str], n: int) -> list[tuple[list[tuple[float, np.ndarray]], np.ndarray]]:
        """The ``n`` best segmentations of whole texts with their scores, and the texts' own ids."""
        words, units_, ways = self.kept(n)
        different, times, word, sizes = self.different(texts)
        word = words.all(different, times)[word]
        numbers, many = words.runs[0]
        unit = numbers[_gathered(many, word)]
        ends = np.concatenate(([0], np.cumsum(many[word])))[np.concatenate(([0], np.cumsum(sizes)))]
        own, first = (units_.of(part, unit, ends) for part in (0, 1))
        facts, bounds = units_.runs[2][0][unit], ends.tolist()
        opens = []
        for i, j in itertools.pairwise(bounds):
            # a departure costs; the n cheapest words to depart in are all that n results can need
            gaps = facts["gap"][i:j]
            least = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) <= 4 * n else _least(gaps, n - 1)
            opens.append([k for k in least.tolist() if gaps[k] < np.inf])
        asked = np.array([i + k for i, some in zip(bounds, opens) for k in some], dtype=np.int64)
        found = iter(ways.all([units_.cut[u] for u in unit[asked].tolist()]))
        scores, sizes, out = facts["score"].tolist(), facts["size"], []
        for t, (i, j) in enumerate(itertools.pairwise(bounds)):
            paths = list(itertools.islice(found, len(opens[t])))
            out.append((_chained(first[t], sum(scores[i:j]), sizes[i:j], opens[t], paths, n), own[t] if self.plain is not None else self.own(texts[t])))
        return out

    def n_best(self, text: str, n: int = N_BEST) -> list[Path]:
        """The ``n`` best segmentations of a whole text."""
        return [(score, tuple(ids.tolist())) for score, ids in self.segments([text], n)[0][0]]

    def written(self, ids: np.ndarray) -> str:
        """As ``decode``, for an array of ids."""
        raw = self.raw.take(pa.array(ids))
        _, ends, data = raw.buffers()
        text = data.to_pybytes()[: np.frombuffer(ends, dtype=np.int32)[len(raw)]] if len(raw) else b""
        # a space may be spelt in bytes as well
        text = text.replace(SPACE.encode(), b" ").decode(errors="replace")
        return text[1:] if text.startswith(" ") else text

    def decode(self, ids) -> str:
        """The text that ids stand for; bytes that are no character become U+FFFD."""
        out, data = [], bytearray()
        for i in ids:
            if i in self.names:
                data.append(self.names[i])
                continue
            if data:
                out.append(data.decode(errors="replace"))
                data = bytearray()
            out.append(self.texts[i])
        out.append(data.decode(errors="replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def apart(pieces_) -> str:
    """Signs that share no piece with a letter side by side."""
    near = {c for piece in pieces_ for a, b in zip(piece, piece[1:]) for c, other in ((a, b), (b, a)) if other.isalpha()}
    return "".join(c for c in ".,;:!?\n\t()[]{}\"|" if c not in near)


def units(pieces_) -> re.Pattern:
    """What cuts a text into words, and a word between a letter and a sign that share no piece side by side."""
    signs = re.escape(apart(pieces_))
    if not signs:
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    letter = r"[^\W\d_]"
    inside = f"{letter}(?![{signs}])|[{signs}](?!{letter})|(?!{letter})[^{SPACE}{signs}]"
    return re.compile(f"{SPACE}*(?:{inside})*[^{SPACE}]|{SPACE}+")


def by_words(path: str) -> sentencepiece.SentencePieceProcessor | None:
    """The model without the space it puts before a text, if it leaves texts as they are and encodes by merges.

    Merges happen inside of pieces, so its encoding of a normalised text is that of its words, one after another.
    """
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kind, norm = model.trainer_spec, model.normalizer_spec
    same = not (norm.precompiled_charsmap or norm.normalization_rule_tsv or norm.remove_extra_whitespaces)
    same = same and norm.add_dummy_prefix and norm.escape_whitespaces and not kind.treat_whitespace_as_suffix
    if not (same and kind.model_type == kind.BPE and kind.byte_fallback and all(p.type not in (p.USER_DEFINED, p.UNUSED) for p in model.pieces)):
        return None
    norm.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


class Trie:
    """All pieces by their characters, for looking up many places of a text at once."""

    def __init__(self, ids: dict[str, int]):
        alphabet = sorted({ord(c) for text in ids for c in text}, key=lambda c: (c != ord(SPACE), c))
        self.kinds = np.zeros(0x110000, dtype=np.uint16 if len(alphabet) < 1 << 16 else np.uint32)
        self.kinds[alphabet] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        nodes = {text: i for i, text in enumerate(sorted({text[:end] for text in ids for end in range(len(text) + 1)}, key=len))}
        self.pieces = np.array([ids.get(text, -1) for text in nodes])
        steps = sorted((nodes[t[:-1]] * self.width + int(self.kinds[ord(t[-1])]), node) for t, node in nodes.items() if t)
        self.steps, self.after = (np.array(x, dtype=np.int64) for x in zip(*steps, strict=True))
        # the steps from nodes near the root by the first characters, in a table
        near = sum(len(t) < NEAR for t in nodes)
        self.table = np.full((near, COMMON), -1, dtype=np.int32)
        node, kind = self.steps // self.width, self.steps % self.width
        some = (node < near) & (kind < COMMON)
        self.table[node[some], kind[some]] = self.after[some]

    def next(self, node: np.ndarray, kind: np.ndarray, length: int) -> np.ndarray:
        """The nodes after nodes of a length, or -1."""
        if length >= NEAR:
            key = node * self.width + kind
            place = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            return np.where(self.steps[place] == key, self.after[place], -1)
        found = self.table[node, np.minimum(kind, COMMON - 1)].astype(np.int64)
        rare = np.flatnonzero(kind >= COMMON)
        if len(rare):
            found[rare] = self.next(node[rare], kind[rare], NEAR)
        return found

    def walk(self, chars: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, length and id of every piece that stands in ``chars`` and does not pass the ``ahead`` characters left."""
        kinds = self.kinds[chars].astype(np.int64)
        at = np.flatnonzero(ahead > 0)
        node, length, out = np.zeros(len(at), dtype=np.int64), 0, []
        while len(at):
            node = self.next(node, kinds[at + length], length)
            there = node >= 0
            at, node, length = at[there], node[there], length + 1
            whole = self.pieces[node] >= 0
            out.append((at[whole], np.full(int(whole.sum()), length), self.pieces[node[whole]]))
            more = ahead[at] > length
            at, node = at[more], node[more]
        at, length, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        return at, length, piece


def _merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least of two columns of rising numbers, as many as one has, rising; a power of two."""
    least = np.minimum(one, other[::-1])
    apart = len(least) // 2
    while apart:
        pairs = least.reshape(-1, 2, apart, least.shape[-1])
        low, high = pairs[:, 0], pairs[:, 1]
        least = np.stack([np.minimum(low, high), np.maximum(low, high)], axis=1).reshape(least.shape)
        apart //= 2
    return least


def _units(ways: np.ndarray, scores: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> list[tuple]:
    """What a chain needs of each unit: cost of the first departure, score, best ids, and all else, see :func:`_paths`.

    Units have that many ``ways``, best first; ``scores`` and ``sizes`` are of the ways, ``ids`` of all on end.
    """
    out = []
    data, costs, lengths = ids.astype("<i4").tobytes(), scores.astype("<f8").tobytes(), sizes.astype("<i4").tobytes()
    ends, scores, at, start = (np.cumsum(sizes) * 4).tolist(), scores.tolist(), 0, 0
    for m in ways.tolist():
        end, last = ends[at], ends[at + m - 1]
        rest = costs[8 * at : 8 * (at + m)] + lengths[4 * at : 4 * (at + m)] + data[end:last] if m > 1 else None
        out.append((scores[at] - scores[at + 1] if m > 1 else np.inf, scores[at], data[start:end], rest, m))
        at, start = at + m, last
    return out


def _unit(paths: list[Path]) -> tuple:
    """As :func:`_units`, for one unit's paths."""
    scores, ids = zip(*paths, strict=True)
    sizes = np.array([len(i) for i in ids])
    return _units(np.array([len(paths)]), np.array(scores, dtype=np.float64), sizes, _flat(ids))[0]


def _paths(unit: tuple) -> list[tuple[float, np.ndarray]]:
    """All ways of a unit that has several."""
    _, _, best, rest, m = unit
    ids = np.concatenate([np.frombuffer(best, dtype="<i4"), np.frombuffer(rest, dtype="<i4", offset=12 * m)])
    ends = [0, *itertools.accumulate(np.frombuffer(rest, dtype="<i4", offset=8 * m, count=m).tolist())]
    parts = [ids[i:j] for i, j in itertools.pairwise(ends)]
    return list(zip(np.frombuffer(rest, dtype="<f8", count=m).tolist(), parts, strict=True))


_BEST = operator.itemgetter(2)
FACTS = np.dtype([("gap", "<f8"), ("score", "<f8"), ("size", "<i8")])  # of a unit; the size is that of its best way


def _arrays(paths: list[Path]) -> list[tuple[float, np.ndarray]]:
    return [(score, np.array(ids, dtype="<i4")) for score, ids in paths]


def _slices(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The bytes of runs of values that have these sizes."""
    data, ends = values.tobytes(), (np.cumsum(sizes) * values.itemsize).tolist()
    return [data[i:j] for i, j in itertools.pairwise([0, *ends])]


def _gathered(sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the elements of the runs ``at``, one run after the other; runs of these sizes lie on end."""
    mine = sizes[at]
    skip = (np.cumsum(sizes) - sizes)[at] - (np.cumsum(mine) - mine)
    return np.arange(int(mine.sum())) + np.repeat(skip, mine)


def _chained(first: np.ndarray, best: float, sizes: np.ndarray, open_: list[int], lists: list, n: int) -> list[tuple[float, np.ndarray]]:
    """The ``n`` best ways of a chain of units, of which the best is ``first``, by departures in ``open_`` units."""
    out = [(best, first)]
    if open_:
        starts = np.concatenate(([0], np.cumsum(sizes)))
        heap = [(0.0, (0,) * len(lists))]
        seen = {heap[0][1]}
        while heap and len(out) <= n:
            cost, ranks = heapq.heappop(heap)
            if any(ranks):
                parts, at = [], 0
                for i, paths, rank in sorted(zip(open_, lists, ranks, strict=True), key=operator.itemgetter(0)):
                    if rank:
                        parts += [first[at : starts[i]], paths[rank][1]]
                        at = starts[i + 1]
                out.append((best - cost, np.concatenate([*parts, first[at:]])))
            for k, paths in enumerate(lists):
                if ranks[k] + 1 < len(paths):
                    after = (*ranks[:k], ranks[k] + 1, *ranks[k + 1 :])
                    if after not in seen:
                        seen.add(after)
                        heapq.heappush(heap, (cost + paths[ranks[k]][0] - paths[ranks[k] + 1][0], after))
    return out[:n]


def _flat(lists: list) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(lists), dtype="<i4")


def _order(values: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0; where all are small, numpy sorts them by digits."""
    return np.argsort(values.astype(np.uint16) if values.max(initial=0) < 1 << 16 else values, kind="stable")


def _least(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least values, ties to smaller places."""
    if k < 1:
        return np.empty(0, dtype=np.int64)
    some = np.flatnonzero(values <= np.partition(values, k - 1)[k - 1])
    return some[np.argsort(values[some], kind="stable")[:k]]


def normalised(text: str) -> str:
    """A space before the text, and spaces as a visible character. An empty text stays empty."""
    return (" " + text).replace(" ", SPACE) if text else ""


@functools.lru_cache(maxsize=1)  # a worker that begins to count lets go of the words of an earlier run
def pieces(path: str, scores: bytes | None = None) -> Pieces:
    return Pieces(path, None if scores is None else np.frombuffer(scores).tolist())


def _counted(path: str):
    def run(batches):
        seen = pieces(path).own_counts(text for batch in batches for text in batch["text"])
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"piece": at.astype("int32"), "n": seen[at]})

    return run


def log_probabilities(rows: DataFrame, model: str | None = None) -> np.ndarray:
    """Log probability of every piece of the model in the texts of all rows, as the model itself encodes them.

    Each piece counts once more than it occurs, so none is impossible. Each task hands on one row a piece;
    what the driver gets is one number for each piece of the vocabulary.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    found = rows.selectExpr("cast(text as string) as text").mapInPandas(_lean(_counted(path)), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    seen = np.ones(len(pieces(path).texts))
    seen[found["piece"].to_numpy(dtype=np.int64)] += found["n"].to_numpy(dtype=np.float64)
    return np.rint(np.log(seen / seen.sum()) * GRAIN) / GRAIN


def _some(texts, characters: int):
    """Lists of texts that together have so many characters; the last has fewer."""
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text)
        if held >= characters:
            yield some
            some, held = [], 0
    yield some


def _ahead(model: Pieces, texts, n: int):
    """Texts, none for null, with what ``segments`` gives of each, some texts at a time."""
    for some in _some((text or "" for text in texts), AHEAD):
        yield from zip(some, model.segments(some, n), strict=True)


def _encoded(path: str, n: int, scores: bytes | None = None):
    def run(batches):
        model = pieces(path, scores)
        for batch in batches:
            rest, out, first, held = batch.drop(columns=["text"]), [], 0, 0
            for at, (text, (found, own)) in enumerate(_ahead(model, batch["text"], n), 1):
                ids = [i for _, i in found]
                out.append((ids, [float(s) for s, _ in found], zlib.crc32(ids[0].tobytes()), model.written(ids[0]) == text, own))
                held += sum(map(len, ids)) + len(own)
                if held >= HELD or at == len(batch):
                    done = rest.iloc[first:at]
                    columns = zip(*out, strict=True)
                    yield done.assign(**{c: list(v) for c, v in zip(("_op_ids", "_op_scores", "_op_crc", "_op_same", "_op_own"), columns, strict=True)})
                    out, first, held = [], at, 0

    return run


def _nested(lists: list) -> pa.ListArray:
    """Lists as one Arrow array, arrays of numbers on end."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    inner = [x for some in lists for x in some] if lists and isinstance(lists[0], list) else None
    values = _nested(inner) if inner and isinstance(inner[0], np.ndarray) else pa.array(inner) if inner else pa.array(np.concatenate(lists))
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype("int32"), values)


def _in_arrow(path: str, n: int, scores: bytes):
    """As :func:`_encoded`, for Arrow batches; the other columns pass as they are."""

    def run(batches):
        for batch in batches:
            same = [c for c in batch.schema.names if c != "text"]
            first = 0
            for part in _encoded(path, n, scores)([pd.DataFrame({"text": batch.column("text").to_pylist()})]):
                made = {c: _nested(list(part[c])) for c in ("_op_ids", "_op_scores", "_op_own")}
                made |= {"_op_crc": pa.array(part["_op_crc"], pa.int64()), "_op_same": pa.array(part["_op_same"], pa.bool_())}
                old = {c: batch.column(c).slice(first, len(part)) for c in same}
                out = old | {c: made[c] for c in ("_op_ids", "_op_scores", "_op_crc", "_op_same", "_op_own")}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
                first += len(part)
            give_back()  # the searches' arrays; a task's batches would add up free memory

    return run


def encode(rows: DataFrame, n: int = N_BEST, model: str | None = None, scores: np.ndarray | None = None) -> DataFrame:
    """Adds n_best (ids of up to ``n`` segmentations, best first), scores, ids_crc32, round_trip and own_ids.

    ids_crc32 is that of the best segmentation as little-endian 32-bit numbers; round_trip tells whether
    it decodes to the text; own_ids is the encoding by the model's own rule, which is not always among the
    n best. A segmentation's score is the sum of its pieces' ``scores``, by default their
    ``log_probabilities`` over all rows; of equal ones the smaller ids come first within a word.
    Characters that are no piece are spelt in bytes.

    A null or empty text has one empty segmentation with score 0. Every row is looked at for itself; an
    empty table gives an empty one. Columns of the names added are replaced; names that begin with
    ``_op_`` are the operator's own.
    """
    if n < 1:
        raise ValueError("n must be positive")
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    given = np.asarray(log_probabilities(rows, path) if scores is None else scores, dtype=np.float64).tobytes()
    made = {"n_best": "_op_ids", "scores": "_op_scores", "ids_crc32": "_op_crc", "round_trip": "_op_same", "own_ids": "_op_own"}
    same = [c for c in rows.columns if c not in made and c != "text"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in same)
    out = f"{kinds}{', ' if kinds else ''}_op_ids array<array<int>>, _op_scores array<double>, _op_crc long, _op_same boolean, _op_own array<int>"
    found = rows.selectExpr(*[f"`{c}`" for c in same], "cast(text as string) as text").mapInArrow(_lean(_in_arrow(path, n, given)), out)
    return found.withColumnsRenamed({v: k for k, v in made.items()})


def decode(rows: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """Adds text, decoded from the column ``ids``; null where that is null, whatever the other rows hold."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    same = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in same)

    def run(batches):
        for batch in batches:
            yield batch.assign(text=[None if i is None else pieces(path).decode(list(i)) for i in batch[ids]])

    return rows.select(*same).mapInPandas(run, f"{kinds}, text string")
