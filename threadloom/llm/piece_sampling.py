"""SentencePiece encoding and decoding: distinct sampled segmentations.

A text's lattice has an edge for each vocabulary piece that matches somewhere
(characters without a piece become one edge of byte pieces). Every edge has a
log weight, a segmentation the sum of its edges' weights; a backward pass gives the log mass of all
completions of every node, hence exact conditional probabilities.

Samples without replacement are the segmentations with the largest
Gumbel-perturbed log probabilities, found best-first: a queue holds disjoint
sets of segmentations, each with the exact maximum of its perturbed values. The
best set is popped, the maximum inside it is drawn by following conditional
probabilities, and what remains of the set is split, step by step along the
drawn path, into the sets of paths that leave it there; their maxima are
Gumbels truncated at the popped one. Bounds are exact, so every pop emits a
sample and nothing is searched in vain.

With threshold t, the perturbed value of the first segmentation that is not
emitted, the inclusion score of one with log probability p is
1 - exp(-exp(p - t)).

Uniform numbers are hashes of the row's key, the sample's number and the
position, so results do not depend on how rows are grouped into batches.

Pieces of a byte-pair model carry ranks, not log probabilities; their weight is
-ALPHA * ln(rank + 2). Models with log probabilities use ALPHA * score.
Lattices of words (a new word begins at a space mark after another character)
are built once per slice and shared by all places where the word stands, if no
piece of the vocabulary spans two words; otherwise a text is one word.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.shared import map_arrow, slices

SAMPLES, ALPHA = 2, 1.0
MODEL = "piece_bpe_32k.model"
SEED = 20240229
SLICE = 200_000
#: Places of lattices that a task keeps from one slice to the next.
KEPT_PLACES = 200_000
_MARK = "▁"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_WORD = re.compile(f"{_MARK}+[^{_MARK}]*|[^{_MARK}]+")
_LOADED: dict = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def stream(seeds: np.ndarray, number: int) -> np.ndarray:
    """Seeds of one stream of numbers for each row."""
    return _mix(seeds + np.array([number + 1], np.uint64) * _A)


def uniform(seeds: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1, by the seed of a stream and a place."""
    h = _mix(seeds + place.astype(np.uint64) * _C)
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


class Vocabulary:
    """Pieces of a model file: lookup by hash, log weights, decoding."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        scores = [model.get_score(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.one_byte = np.array([self.bytes.get(c, self.unknown) for c in range(128)])
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        rule = proto.normalizer_spec
        #: Whether normalizing only marks spaces and puts one in front.
        self.plain = not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
        usable = [i for i in range(size) if not special[i] and not model.is_byte(i) and self.pieces[i]]
        ranks = all(scores[i] == int(scores[i]) <= 0 for i in usable)
        self.weight = np.array([-alpha * math.log(2 - s) if ranks else alpha * s for s in scores])
        self.fallback = -alpha * math.log(size + 2) if ranks else float(min((self.weight[i] for i in usable), default=0.0)) - 10 * alpha
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        self.split = not any(a != _MARK and b == _MARK for i in usable for a, b in zip(self.pieces[i], self.pieces[i][1:], strict=False))
        # all beginnings of pieces; ids of those that are pieces, else -1
        known = {self.pieces[i][:n]: -1 for i in usable for n in range(1, len(self.pieces[i]))}
        known.update((self.pieces[i], i) for i in usable)
        hashes = np.array([self._hash(p) for p in known], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(known.values()), np.int32)[order]
        if len(np.unique(self.hashes)) != len(self.hashes):
            raise ValueError("two pieces share a hash")
        # an entry for the first piece of each slot; the few others are searched for
        slots = (self.hashes >> np.uint64(43)).astype(np.int64)
        self.table = np.full(1 << 21, -1, np.int32)
        first = np.unique(slots, return_index=True)[1]
        self.table[slots[first]] = first
        self.crowded = np.zeros(1 << 21, bool)
        self.crowded[slots[np.setdiff1d(np.arange(len(slots)), first)]] = True
        decoded = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] and i != self.unknown else p.replace(_MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.width = np.array([len(d) for d in decoded], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.text = np.frombuffer(b"".join(decoded), np.uint8)
        self.lattices = Lattices(self)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * int(_A) & 0xFFFFFFFFFFFFFFFF
        h = (h ^ h >> 30) * int(_B) & 0xFFFFFFFFFFFFFFFF
        h = (h ^ h >> 27) * int(_C) & 0xFFFFFFFFFFFFFFFF
        return h ^ h >> 31

    @staticmethod
    def step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h + code + np.uint64(1)) * _A

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the beginnings of pieces, or -1."""
        slot = (h >> np.uint64(43)).astype(np.int64)
        at = self.table[slot]
        got = np.where((at >= 0) & (self.hashes[at] == h), at, -1)
        rest = np.flatnonzero(got < 0)
        rest = rest[self.crowded[slot[rest]]]
        if len(rest):
            near = np.minimum(np.searchsorted(self.hashes, h[rest]), len(self.hashes) - 1)
            got[rest] = np.where(self.hashes[near] == h[rest], near, -1)
        return got

    def normalized(self, text: str) -> str:
        return self.model.normalize(text)

    def spaced(self, text: str) -> bool:
        """Whether the text is words between single spaces, so that normalizing it only marks these."""
        return self.plain and self.split and text[0] != " " and "  " not in text and _MARK not in text and "\0" not in text

    def decoded(self, text: str) -> str:
        """What decoding any segmentation of the text gives."""
        return text if self.spaced(text) else self.normalized(text).replace(_MARK, " ").removeprefix(" ")

    def words(self, text: str) -> list[str]:
        """The parts of the normalized text whose lattices are independent."""
        if self.spaced(text):
            return (_MARK + text.replace(" ", "\0" + _MARK)).split("\0")
        norm = self.normalized(text)
        return (_WORD.findall(norm) if self.split else [norm]) if norm else []

    def decode(self, ids) -> str:
        """The text of a segmentation: pieces joined, marks as spaces, without the leading space that encoding adds."""
        ids = np.asarray(ids, np.int64)
        width = self.width[ids]
        stop = np.cumsum(width)
        at = np.repeat(self.begin[ids] - stop + width, width) + np.arange(int(stop[-1]) if len(ids) else 0)
        return self.text[at].tobytes().decode("utf-8", "replace").removeprefix(" ")


def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    """The model in the file, loaded once in a worker."""
    if (path, alpha) not in _LOADED:
        _LOADED[path, alpha] = Vocabulary(path, alpha)
    return _LOADED[path, alpha]


def _forget() -> None:
    """Drop the lattices that this worker keeps; the models stay."""
    for vocab in _LOADED.values():
        vocab.lattices = Lattices(vocab)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_PLACES = {"is_end": bool, "first": np.int32, "count": np.int8}
_EDGES = {"start": np.int32, "end": np.int32, "piece": np.int32, "logp": np.float64, "cum": np.float64, "rest": np.float64}


class Lattices:
    """Lattices of many words at once. Node n of the word that starts at place b is b + n; a word has a place for each character and one for its end.

    `numbers` names the words that are kept from one slice to the next. Arrays have
    room to grow, so that adding words does not move those that are there.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.numbers: dict[str, int] = {}
        self.base = np.zeros(1, np.int64)
        self.places = self.edges = 0
        for name, kind in (_PLACES | _EDGES).items():
            setattr(self, name, np.empty(0, kind))

    def __len__(self):
        return self.places

    def _append(self, size: int, **columns: np.ndarray) -> None:
        """Write columns of equal length behind the first `size` values of their arrays."""
        for name, values in columns.items():
            held = getattr(self, name)
            if size + len(values) > len(held):
                room = np.empty((size + len(values)) * 5 // 4, held.dtype)
                room[:size] = held[:size]
                setattr(self, name, room)
                held = room
            held[size : size + len(values)] = values

    def add(self, words: list[str]) -> None:
        """Build the lattices of words, which get the next numbers."""
        if not words:
            return
        vocab, shift, before = self.vocab, self.places, self.edges
        lengths = np.array([len(w) for w in words], np.int64)
        base = np.concatenate([[0], np.cumsum(lengths + 1)])
        codes = np.zeros(int(base[-1]), np.uint64)
        inside = np.ones(len(codes), bool)
        inside[base[1:] - 1] = False
        codes[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        left = np.repeat(base[1:] - 1, lengths + 1) - np.arange(len(codes))  # characters up to the word's end
        # places in order of what is left of their word, so that every backward step is one range
        ranked = np.argsort(np.minimum(left, 0xFFFF).astype(np.uint16), kind="stable")
        if left.max() >= 0xFFFF:
            ranked = np.argsort(left, kind="stable")
        rank = np.empty(len(codes), np.int64)
        rank[ranked] = np.arange(len(codes))
        starts, pieces = [], []
        at = np.flatnonzero(inside)
        h = np.zeros(len(at), np.uint64)
        for size in range(1, vocab.longest + 1):
            if not len(at):
                break
            h = vocab.step(h, codes[at + size - 1])
            got = vocab.find(_mix(h))
            found = np.where(got >= 0, vocab.ids[got], np.int32(-1))
            if size == 1:  # characters without a piece: one edge of byte pieces, as -1 - code
                starts.append(at)
                pieces.append(np.where(found >= 0, found, -1 - codes[at].astype(np.int32)).astype(np.int32))
            else:
                hit = np.flatnonzero(found >= 0)
                starts.append(at[hit])
                pieces.append(found[hit])
            # on to those that some longer piece begins like, and that have a character left
            keep = np.flatnonzero((got >= 0) & (left[at] > size))
            at, h = at[keep], h[keep]
        spread = np.zeros(len(codes), np.int64)  # edges of each place, by rank
        for own in starts:
            spread[rank[own]] += 1
        begin = np.cumsum(spread) - spread
        total = int(spread.sum())
        start, size, piece = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.int32)
        filled = begin.copy()
        for n, (own, found) in enumerate(zip(starts, pieces, strict=True), 1):
            slot = filled[rank[own]]
            filled[rank[own]] += 1
            start[slot], size[slot], piece[slot] = own, n, found
        weight = np.where(piece >= 0, vocab.weight[np.maximum(piece, 0)], 0.0)
        lone = np.flatnonzero(piece < 0)
        code = -1 - piece[lone]
        weight[lone] = vocab.fallback * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        piece[lone] = np.where(code < 128, vocab.one_byte[np.minimum(code, 127)], piece[lone])
        # log mass of all completions, from the ends of the words backwards
        end = start + size
        beta = np.zeros(len(codes))
        group = begin[spread > 0]  # first edge of each place
        owner = ranked[spread > 0]
        spread = spread[spread > 0]
        far = left[owner]
        cuts = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1]]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(far)], strict=True):
            low, high = int(group[a]), int(group[b - 1] + spread[b - 1])
            mass = weight[low:high] + beta[end[low:high]]
            first = group[a:b] - low
            top = np.maximum.reduceat(mass, first)
            beta[owner[a:b]] = top + np.log(np.add.reduceat(np.exp(mass - np.repeat(top, spread[a:b])), first))
        logp = np.minimum(weight + beta[end] - beta[start], 0.0)
        first, count = np.full(len(codes), -1, np.int32), np.zeros(len(codes), np.int8)
        first[owner], count[owner] = group + before, spread
        # cumulative probabilities inside each node; the last edge takes what rounding leaves
        cum = np.exp(logp)
        last = group + spread - 1
        at = group
        for n in range(1, int(spread.max())):
            at = at[spread > n] + 1
            spread = spread[spread > n]
            cum[at] += cum[at - 1]
        cum[last] = np.inf
        with np.errstate(divide="ignore"):
            others = np.log1p(-np.exp(logp))
        others[group[count[owner] == 1]] = -np.inf
        self.base = np.concatenate([self.base, base[1:] + shift])
        self._append(shift, is_end=~inside, first=first, count=count)
        self._append(before, start=start + np.int32(shift), end=end + np.int32(shift), piece=piece, logp=logp, cum=cum, rest=others)
        self.places, self.edges = shift + len(inside), before + total

    def mark(self) -> tuple[int, int, int]:
        return len(self.base), self.places, self.edges

    def back_to(self, mark: tuple[int, int, int]) -> None:
        """Forget the lattices that were added after a mark."""
        words, self.places, self.edges = mark
        self.base = self.base[:words]

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """One edge of each node by its conditional probability."""
        edge = self.first[node].astype(np.int64)
        open_ = np.flatnonzero(u > self.cum[edge])
        while len(open_):
            edge[open_] += 1
            open_ = open_[u[open_] > self.cum[edge[open_]]]
        return edge

    def ids(self, edges: np.ndarray) -> np.ndarray:
        pieces = self.piece[edges]
        lone = np.flatnonzero(pieces < 0)
        if len(lone):
            parts, at = [], 0
            for i in lone.tolist():
                raw = chr(-1 - int(pieces[i])).encode()
                parts += [pieces[at:i], [self.vocab.bytes[b] for b in raw] if self.vocab.bytes else [self.vocab.unknown]]
                at = i + 1
            pieces = np.concatenate([*parts, pieces[at:]])
        return pieces.astype(np.int32, copy=False)


def seed_of(key, seed: int = SEED) -> int:
    return xxhash.xxh3_64_intdigest(repr(key).encode(), seed)


def log_inclusion(x: float) -> float:
    """ln(1 - exp(-exp(x))); it is x itself where that is small, so it never underflows."""
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def sample_texts(vocab: Vocabulary, keys: list, texts: list[str | None], samples: int = SAMPLES, seed: int = SEED) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to `samples` tuples (ids, log probability, perturbed log probability, log inclusion score), best first.

    A null or empty text has one segmentation, the empty one.
    """
    own = [vocab.words(text) if text else [] for text in texts]
    flat = list(chain.from_iterable(own))
    lattices = vocab.lattices
    if len(lattices) > KEPT_PLACES:
        lattices = vocab.lattices = Lattices(vocab)
    different = dict.fromkeys(flat)
    known = lattices.numbers
    number = np.fromiter(map(known.get, different, repeat(-1)), np.int64, len(different))
    different.update(zip(different, range(len(different)), strict=True))
    kind = np.fromiter(map(different.__getitem__, flat), np.int64, len(flat))
    new = number < 0
    often = new & (np.bincount(kind, minlength=len(different)) > 1)
    # words that stand here once are built last, to be forgotten after the slice
    kept = [w for w, o in zip(different, often.tolist(), strict=True) if o]
    once = [w for w, o in zip(different, (new & ~often).tolist(), strict=True) if o]
    number[often] = np.arange(len(known), len(known) + len(kept))
    known.update(zip(kept, number[often].tolist(), strict=True))
    number[new & ~often] = np.arange(len(known), len(known) + len(once))
    kind = number[kind]
    lattices.add(kept)
    mark = lattices.mark()
    lattices.add(once)
    stops = np.cumsum([len(words) for words in own])
    spans = list(zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True))
    base = lattices.base[kind]
    length = lattices.base[kind + 1] - base - 1
    place = np.concatenate([[0], np.cumsum(length)])  # of each word among all characters
    from_, to = (np.array([place[s[i]] for s in spans], np.int64) for i in (0, 1))
    seeds = np.array([seed_of(k, seed) for k in keys], np.uint64)
    docs = len(texts)
    owner = np.repeat(np.arange(docs), [b - a for a, b in spans])
    root = -np.log(-np.log(uniform(stream(seeds, 0), np.zeros(docs))))
    paths = np.full((samples, int(place[-1])), -1, np.int32)
    emitted: list[list] = [[] for _ in range(docs)]
    # sets: (-maximum, tie, mass, path that it leaves, place where it leaves, edges that it may not take there)
    queues: list[list] = [[(-root[d], 0, 0.0, -1, int(from_[d]), ())] for d in range(docs)]
    for turn in range(samples):
        split, free_draws, noises = (stream(seeds, 3 * turn + k) for k in (1, 2, 3))
        popped = [heapq.heappop(q) if q else None for q in queues]
        live = np.array([d for d in range(docs) if popped[d] is not None], np.int64)
        path = paths[turn]
        resume = np.full(docs, np.iinfo(np.int64).max)  # where free drawing begins
        rests = []
        for d in live.tolist():
            top, _, mass, parent, at, banned = popped[d]
            if parent < 0:
                resume[d] = from_[d]
                continue
            path[from_[d] : at] = paths[parent, from_[d] : at]
            w = int(np.searchsorted(place, at, "right")) - 1
            node = int(base[w] + at - place[w])
            first, n = int(lattices.first[node]), int(lattices.count[node])
            free = [e for e in range(first, first + n) if e not in banned]
            p = np.exp(lattices.logp[free])
            u = float(uniform(split[d : d + 1], np.array([at - from_[d]]))[0]) * p.sum()
            i = min(int(np.searchsorted(np.cumsum(p), u)), len(free) - 1)
            edge = free[i]
            path[at] = edge
            stop = at + int(lattices.end[edge] - lattices.start[edge])
            resume[d] = stop
            if len(free) > 1:
                others = float(np.log(np.delete(p, i).sum()) + mass)
                rests.append((d, others, at, (*banned, edge)))
        # free drawing of all words from `resume` on
        place_from = resume[owner]
        todo = np.flatnonzero(place[1:] > place_from) if len(kind) else np.empty(0, np.int64)
        offset = np.maximum(place_from[todo] - place[todo], 0)
        node, spot = base[todo] + offset, place[todo] + offset
        key = free_draws[owner[todo]]
        local = spot - from_[owner[todo]]
        while len(node):
            edge = lattices.draw(node, uniform(key, local))
            path[spot] = edge
            step = lattices.end[edge] - node
            node, spot, local = node + step, spot + step, local + step
            more = ~lattices.is_end[node]
            node, spot, local, key = node[more], spot[more], local[more], key[more]
        # log probabilities along the paths, and the sets that leave them
        steps = np.flatnonzero(path >= 0)
        edges = path[steps]
        logp = lattices.logp[edges]
        lows, highs = np.searchsorted(steps, from_), np.searchsorted(steps, to)
        before = np.zeros(len(steps))  # log probability before each step
        total = np.zeros(docs)
        for d in live.tolist():
            if highs[d] > lows[d]:
                sums = np.cumsum(logp[lows[d] : highs[d]])
                before[lows[d] + 1 : highs[d]] = sums[:-1]
                total[d] = sums[-1]
        who = np.repeat(np.arange(docs), highs - lows)
        left_out = lattices.rest[edges]  # log probability of the other edges there
        j = np.flatnonzero((steps >= resume[who]) & (left_out > -np.inf))
        d_of = who[j]
        # a set's maximum falls as this grows; it is a Gumbel at the set's mass, cut at the popped maximum
        height = np.log(-np.log(uniform(noises[d_of], steps[j] - from_[d_of]))) - before[j] - left_out[j]
        cut = np.searchsorted(d_of, np.arange(docs + 1))
        want = samples - turn  # sets that can still matter
        for d in live.tolist():
            top = popped[d][0]
            a, b = int(cut[d]), int(cut[d + 1])
            best = range(a, b) if b - a <= want else (a + np.argpartition(height[a:b], want - 1)[:want]).tolist()
            for x in best:
                s = int(j[x])
                value = -float(np.logaddexp(top, height[x]))
                # the mass is kept before the step, for drawing among the other edges later
                heapq.heappush(queues[d], (-value, turn, float(before[s]), turn, int(steps[s]), (int(edges[s]),)))
            emitted[d].append((-top, float(total[d]), edges[lows[d] : highs[d]]))
        for d, others, at, banned in rests:
            u = float(uniform(noises[d : d + 1], np.array([at - from_[d]]))[0])
            value_at = -np.logaddexp(popped[d][0], math.log(-math.log(u)) - others)
            heapq.heappush(queues[d], (-float(value_at), turn, popped[d][2], turn, at, banned))
    out = []
    for found, queue in zip(emitted, queues, strict=True):
        limit = -queue[0][0] if queue else -math.inf
        out.append([(lattices.ids(e), p, float(g), log_inclusion(p - limit) if queue else 0.0) for g, p, e in found])
    lattices.back_to(mark)  # words that stood here once are likely rare
    return out


def sample(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, path: str | None = None, alpha: float = ALPHA, ids: bool = True, seed: int = SEED) -> DataFrame:
    """Rows (key, sample, n_tokens, log_prob, perturbed, inclusion, log_inclusion, ids_sha256, round_trip[, ids]) of every row of df.

    Each row of df gives up to `samples` distinct segmentations, sample 0 first;
    fewer only where no more exist. Null and empty texts have one, without
    tokens. round_trip tells whether decoding gives the normalized text back.
    Rows with equal keys and texts get equal samples; null keys are a key like
    any other; other columns are ignored whatever their names; an empty table
    gives no rows.
    """
    path = path or model_path()
    source = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(path, alpha)
        for part in slices(batches, "text", SLICE):
            keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            at, cols = [], [[] for _ in range(9)]
            for i, found in enumerate(sample_texts(vocab, keys, texts, samples, seed)):
                plain = vocab.decoded(texts[i]) if texts[i] else ""
                for n, (tokens, logp, top, score) in enumerate(found):
                    at.append(i)
                    row = (n, len(tokens), logp, top, math.exp(score), score, hashlib.sha256(tokens.tobytes()).hexdigest(), vocab.decode(tokens) == plain, tokens)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            names = ("sample", "n_tokens", "log_prob", "perturbed", "inclusion", "log_inclusion", "ids_sha256", "round_trip", "ids")
            width = len(names) if ids else len(names) - 1
            made = [pa.array(c, k) for c, k in zip(cols[:8], kinds, strict=False)]
            if ids:
                begins = np.concatenate([[0], np.cumsum(cols[1], dtype=np.int64)])
                made.append(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *cols[8]]))))
            yield pa.record_batch([part.column(0).take(pa.array(at, pa.int64())), *made], names=["key", *names[:width]])

    schema = f"key {kind}, sample int, n_tokens long, log_prob double, perturbed double, inclusion double, log_inclusion double, ids_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    return map_arrow(source, run, schema, _forget).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERY = ("op7_piece_sampling", query)
