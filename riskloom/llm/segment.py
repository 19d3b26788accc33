"""SentencePiece encoding and decoding with sampled segmentations.

A text's lattice has every vocabulary piece at every place (bytes for characters
that are no piece).  It is held in parts that no piece crosses: words with the space
marks before them, and words of more than ``WORD_MAX`` characters taken apart wherever
the vocabulary has no piece over the place.  A segmentation's probability is
proportional to the product of its pieces' weights (by vocabulary rank).  The
``k`` segmentations of the largest Gumbel-perturbed log-probability are ``k``
draws without replacement.  They are found by best-first search: a node is a prefix
with the set of its next pieces still open, its bound a Gumbel variable at the log
of the set's mass, truncated at its parent's value.  As lattice masses are exact,
expanding a node is a forward walk, done for all words of a batch at once.

Random numbers are hashes of (row key, draw, word, place): a row's samples do not
depend on its neighbours.  With ``kappa`` the best bound left open, a sample's
inclusion score is ``1 - exp(-exp(log p - kappa))``, 1 where nothing is left.

Nulls: a null text is the empty text, whose one segmentation has no piece.
Texts with fewer than ``k`` segmentations give those they have.  Repeated rows get
equal samples.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import long_text_batches

WORD_MAX = 64           # longer words are searched for places that no piece crosses
BLOCK = 1 << 18         # characters that are searched at a time
LARGEST = 38.0          # over any standard Gumbel variable that a 53-bit uniform gives
BELOW_ONE = np.float32(1 - 2 ** -24)
NEAR = 24               # open sets that are made exact at a time
SAMPLES = 2
BATCH_CHARS = 2_000_000
MARK = "▁"
APART = "\0"            # in no piece
PIECE, LONGER = 1, 2    # what may have a hash
OUT = ("doc_id bigint, rank int, n_pieces bigint, ids_crc32 bigint, log_prob double, perturbed double, "
       "inclusion double, decoded_crc32 bigint")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def model_path() -> str:
    import public_tokenizers as P
    return P.path("piece_bpe_32k.model")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def times(n: int, by: np.uint64) -> np.uint64:
    return np.uint64(n * int(by) & (1 << 64) - 1)


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64-bit counters."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def char_codes(chars: np.ndarray) -> np.ndarray:
    return mix(chars.astype(np.uint64) * _A + _C) | np.uint64(1)


class Vocabulary:
    """Pieces by hash, with ids and log weights."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_id = np.zeros(256, np.int64)
        string = [b""] * sp.get_piece_size()
        words, ids, rank = [], [], []
        worst = 1 + max(-sp.get_score(i) for i in range(sp.get_piece_size()) if sp.get_score(i) > -1e8)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                string[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                words.append(piece)
                string[i] = piece.replace(MARK, " ").encode()
                ids.append(i)
                rank.append(min(-sp.get_score(i), worst))
        self.strings = np.frombuffer(b"".join(string), np.uint8)
        self.string_size = np.array([len(b) for b in string], np.int64)
        self.string_at = np.cumsum(self.string_size) - self.string_size
        self.byte_weight = -np.log(2 + worst)
        self.longest = max(map(len, words))
        assert not any(MARK in w.lstrip(MARK) or APART in w for w in words)      # what words_of and parts_of go by
        self._powers(1 << 21)
        sums = [self.prefix_sums(to_chars(w))[1:] for w in words]
        h = np.array([int(x[-1]) for x in sums], np.uint64)
        order = np.argsort(h)
        self.hash, self.ids = h[order], np.array(ids, np.int32)[order]
        self.weight = -np.log(2 + np.array(rank))[order]
        assert (self.hash[1:] != self.hash[:-1]).all()
        # by the first bits of a hash: whether a piece, and whether the beginning of a longer one, may have it
        self.seen = np.zeros(1 << 22, np.uint8)
        self.seen[np.concatenate([x[:-1] for x in sums]) >> np.uint64(42)] = LONGER
        self.seen[h >> np.uint64(42)] |= PIECE
        # the first piece of every bucket of hashes, and how many a bucket has at most
        edges = np.searchsorted(self.hash, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
        self.bucket = np.minimum(edges, len(self.hash) - 1).astype(np.int32)
        self.most = int(np.diff(edges, append=len(self.hash)).max())

    def _powers(self, n: int):
        self.up = np.full(n, _A, np.uint64)
        self.up[0] = 1
        self.up = np.multiply.accumulate(self.up)
        self.down = np.full(n, pow(int(_A), -1, 1 << 64), np.uint64)
        self.down[0] = 1
        self.down = np.multiply.accumulate(self.down)

    def prefix_sums(self, chars: np.ndarray) -> np.ndarray:
        if len(chars) > len(self.up):
            self._powers(len(chars))
        out = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(char_codes(chars) * self.up[:len(chars)], out=out[1:])
        return out

    def pieces(self, sums: np.ndarray, at: np.ndarray, k: int):
        """Of the places ``at``, those where a piece of ``k`` characters starts, and its number;
        and those where a longer piece may start."""
        h = (sums[at + k] - sums[at]) * self.down[at]
        seen = self.seen.take(h >> np.uint64(42))
        own = np.flatnonzero(seen & PIECE)
        here, h = at[own], h[own]
        j = self.bucket.take(h >> np.uint64(44))
        for _ in range(self.most - 1):
            j += self.hash.take(j, mode="clip") < h
        ok = self.hash.take(j, mode="clip") == h
        return here[ok], j[ok], at[seen >= LONGER]

    def uncrossed(self, chars: np.ndarray) -> np.ndarray:
        """The places behind a character that no piece crosses."""
        out, n, reach = [], len(chars), 0
        for first in range(0, n, BLOCK):
            size = min(BLOCK, n - first)
            sums = self.prefix_sums(chars[first:first + size + self.longest - 1])
            far = np.arange(1, size + 1)
            at = np.arange(size)
            for k in range(1, self.longest + 1):
                here, _, at = self.pieces(sums, at[:np.searchsorted(at, n - first - k, side="right")], k)
                far[here] = here + k
            far = np.maximum.accumulate(np.maximum(far + first, reach))
            reach = int(far[-1])
            behind = np.arange(first + 1, first + size + 1)
            out.append(behind[far <= behind])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def to_chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def words_of(text: str) -> list[str]:
    """Words of the normalised text, each with the space marks before it."""
    return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)) if text else []


def parts_of(vocab: Vocabulary, words: list[str]) -> dict[str, list[str]]:
    """Each word taken apart at the places that no piece crosses."""
    cuts = vocab.uncrossed(to_chars(APART.join(words)))
    out, first = {}, 0
    for w in words:
        lo, hi = np.searchsorted(cuts, [first + 1, first + len(w)])
        edges = [0, *(cuts[lo:hi] - first).tolist(), len(w)]
        out[w] = [w[i:j] for i, j in zip(edges, edges[1:])]
        first += len(w) + 1
    return out


class Lattice:
    """Lattices of distinct words: at every character (slot), the pieces that start
    there by length, with the probability of each as the next one.  Words are added
    as they come; the slots are emptied beyond ``bound``."""

    def __init__(self, vocab: Vocabulary, bound: int = 1_200_000):
        self.vocab, self.bound = vocab, bound
        self.room = 0
        self.clear()
        self._grow(1)           # texts without a word are looked up too

    def clear(self):
        self.number: dict[str, int] = {}        # word -> its first slot
        self.used = 0

    def _grow(self, n: int):
        if n <= self.room:
            return
        wide = self.vocab.longest
        size = max(n, min(2 * self.room, self.bound + (1 << 18)), 1 << 18)
        for name, shape, kind in (("left", (size,), np.int32), ("id", (size, wide), np.int32), ("log", (size, wide), np.float32),
                                  ("cum", (size, wide), np.float32)):
            new = np.empty(shape, kind)
            if self.used:
                new[:self.used] = getattr(self, name)[:self.used]
            setattr(self, name, new)
        self.room = size

    def slots(self, texts: list[str]) -> list[np.ndarray]:
        """The first slot of every word of each text."""
        if self.used > self.bound:
            self.clear()
        split = [words_of(t) for t in texts]
        number = self.number
        new = set().union(*split).difference(number)        # a word that is taken apart has no slot of its own
        long = sorted(w for w in new if len(w) > WORD_MAX)
        if long:
            parts = parts_of(self.vocab, long)
            split = [words if parts.keys().isdisjoint(words) else [p for w in words for p in parts.get(w, (w,))] for words in split]
            new = set().union(*split).difference(number)
        new = list(new)
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        at = 0
        while at < len(new):                            # pieces within the reach of the hash powers
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + len(self.vocab.up) // 2)))
            self._add(new[at:to])
            at = to
        return [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in split]

    def _add(self, words: list[str]):
        vocab = self.vocab
        words = sorted(words, key=len)                  # words of one length side by side
        chars = to_chars("".join(words))
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size) - size
        end = np.repeat(first + size, size)
        n, wide = len(chars), vocab.longest
        left = end - np.arange(n)
        self._grow(self.used + n)
        own = slice(self.used, self.used + n)
        ids, weight, cum = self.id[own], self.log[own], self.cum[own]       # weights become log probabilities of the next piece
        ids.fill(-1)
        weight.fill(-np.inf)
        cum.fill(1)
        self.left[own] = left
        sums = vocab.prefix_sums(chars)
        at = np.arange(n)
        for k in range(1, wide + 1):
            at = at[left[at] >= k]
            if not len(at):
                break
            here, j, at = vocab.pieces(sums, at, k)
            ids[here, k - 1], weight[here, k - 1] = vocab.ids[j], vocab.weight[j]
        lone = np.flatnonzero(ids[:, 0] < 0)            # no piece: the character's bytes, -2 - its code
        code = chars[lone].astype(np.int64)
        ids[lone, 0] = np.where(code < 128, vocab.byte_id[np.minimum(code, 127)], -2 - code)
        weight[lone, 0] = vocab.byte_weight * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        short = int(np.searchsorted(size, WORD_MAX, side="right"))
        self._long_masses(weight, cum, size[short:], (first + size)[short:])
        lengths, counts = np.unique(size[:short], return_counts=True)
        at = 0
        for length, count in zip(lengths.tolist(), counts.tolist()):
            to = at + length * count
            w = weight[at:to].reshape(count, length, wide)
            c = cum[at:to].reshape(count, length, wide)
            mass = np.zeros((length + 1, count), np.float32)    # log mass of the ways from a character to the word's end
            for i in range(length - 1, -1, -1):
                m = min(length - i, wide)
                total = np.add(w[:, i, :m].T, mass[i + 1:i + 1 + m], order="C")
                top = total.max(0)
                run = np.exp(total - top)
                for j in range(1, m):
                    run[j] += run[j - 1]
                last = run[-1]
                mass[i] = top + np.log(last)
                c[:, i, :m] = np.where(run == last, 1, run / last).T    # 1 from the last piece on
                w[:, i, :m] = (total - mass[i]).T
            at = to
        self.number.update(zip(words, (first + self.used).tolist()))
        self.used += n

    def _long_masses(self, weight: np.ndarray, cum: np.ndarray, size: np.ndarray, end: np.ndarray):
        """What ``_add`` does for words of one length, for long words of any lengths (ascending) side by side."""
        if not len(size):
            return
        wide = self.vocab.longest
        close = np.cumsum(size + 1) - 1                 # the mass behind a word's last character is 0
        mass = np.zeros(close[-1] + 1)
        for d in range(1, int(size[-1]) + 1):
            own = int(np.searchsorted(size, d))         # words that have a character so far from their end
            at, here, m = end[own:] - d, close[own:] - d, min(d, wide)
            total = weight[at, :m] + mass[here[:, None] + np.arange(1, m + 1)]
            top = total.max(1)
            run = np.cumsum(np.exp(total - top[:, None]), axis=1)
            last = run[:, -1:]
            mass[here] = top + np.log(last[:, 0])
            cum[at, :m] = np.where(run == last, 1, run / last)
            weight[at, :m] = total - mass[here][:, None]

    def walk(self, slot: np.ndarray, key: np.ndarray):
        """From each slot to its word's end: (token, slot, length index) of the steps, by token and place."""
        token = np.arange(len(slot))
        wide, cum = self.vocab.longest, self.cum.reshape(-1)
        out = []
        step = 0
        while len(token):
            u = np.minimum(uniform(key + times(step + 1, _C)).astype(np.float32), BELOW_ONE)
            left = self.left.take(slot)
            pick = np.zeros(len(slot), np.int64)
            # the first length whose sum is over u, looked for length by length; no piece is
            # longer than what is left of the word, and the sum of its last one is 1
            some = np.flatnonzero(left > 1)
            at, more = slot.take(some) * wide, u.take(some)
            while len(some):
                beyond = np.flatnonzero(cum.take(at) <= more)
                some, at, more = some.take(beyond), at.take(beyond) + 1, more.take(beyond)
                pick[some] += 1
            out.append((token, slot, pick))
            go = np.flatnonzero(left > pick + 1)
            token, slot, key = token.take(go), (slot + pick + 1).take(go), key.take(go)
            step += 1
        if not out:
            return (np.zeros(0, np.int64),) * 3
        token, slot, pick = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(token, kind="stable")
        return token[order], slot[order], pick[order]


@functools.lru_cache(maxsize=1)
def lattice_of(path: str) -> Lattice:
    """A worker's lattice, kept from task to task."""
    return Lattice(Vocabulary(path))


def gumbel_below(phi: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``phi``, conditioned to be at most ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(phi), -np.inf, phi - np.log(np.exp(np.minimum(phi - bound, 700)) - np.log(u)))


class _Path:
    """A sampled segmentation: its steps, and the bound of the set left open at each step."""

    def __init__(self, lattice, word, slot, pick, top, skip, u):
        self.word, self.slot, self.pick, self.top = word, slot, pick, top
        self.cell = slot * lattice.vocab.longest + pick
        log = lattice.log.reshape(-1).take(self.cell)
        before = np.empty(len(log) + 1)
        before[0] = 0
        np.cumsum(log, dtype=float, out=before[1:])
        self.before, self.total = before, before[-1]
        # bounds from above, by the mass of the whole step, as far as they can matter;
        # the best ones are made exact when asked for
        self.noise = self.open = np.zeros(0)
        self.exact = np.zeros(0, bool)
        self.skip, self.u = skip, u
        self._reach(min(len(log), skip + 256))

    def _reach(self, to: int):
        at = max(len(self.open), self.skip)
        noise = self.u(at - self.skip, to - self.skip)
        self.noise = np.concatenate([self.noise, noise])
        had, gap = len(self.open), max(0, self.skip - len(self.open))
        bound, exact = np.empty(had + gap + to - at), np.zeros(had + gap + to - at, bool)
        bound[:had], exact[:had] = self.open, self.exact
        bound[had:had + gap], exact[had:had + gap] = -np.inf, True
        np.minimum(self.before[at:to] - np.log(-np.log(noise)), self.top, out=bound[had + gap:])
        self.open, self.exact = bound, exact

    def best(self, lattice) -> tuple[float, int]:
        """The largest bound of the open sets, and its step."""
        n = len(self.slot)
        while len(self.open):
            t = int(self.open.argmax())
            if self.exact[t]:
                if len(self.open) == n or self.before[len(self.open)] + LARGEST < self.open[t]:
                    return float(self.open[t]), t
                self._reach(min(n, 2 * len(self.open)))
                continue
            rough = np.where(self.exact, -np.inf, self.open)
            at = np.argpartition(rough, -NEAR)[-NEAR:] if len(rough) > NEAR else np.arange(len(rough))
            at = at[~self.exact[at]]
            others = np.exp(lattice.log.take(self.slot[at], axis=0), dtype=float)
            others[np.arange(len(at)), self.pick[at]] = 0
            with np.errstate(divide="ignore"):
                phi = self.before[at] + np.log(others.sum(1))
            self.open[at] = gumbel_below(phi, self.top, self.noise[at - self.skip])
            self.exact[at] = True
        return -np.inf, -1


def sample_batch(lattice: Lattice, kinds: list[np.ndarray], keys: np.ndarray, k: int):
    """For each text (its words' first slots in ``kinds``) up to ``k`` paths in order, and the best bound left open."""
    counts = np.array([len(x) for x in kinds], np.int64)
    first = np.cumsum(counts) - counts
    kind = np.concatenate(kinds) if len(kinds) else np.zeros(0, np.int64)
    place = np.arange(len(kind)) - np.repeat(first, counts)
    base = np.repeat(keys, counts) + place.astype(np.uint64) * _B
    paths: list[list[_Path]] = [[] for _ in kinds]
    used: list[dict] = [{} for _ in kinds]      # (path, step) -> picks that are taken there

    def finish(draw, docs, word, slot, pick, cut, prefix):
        """Add the walked steps (``cut``: where each text's begin) behind its prefix."""
        for i, d in enumerate(docs):
            w, s, p = (x[cut[i]:cut[i + 1]] for x in (word, slot, pick))
            top, skip, head = prefix[i]
            if head is not None:
                w, s, p = (np.concatenate([a, b]) for a, b in zip(head, (w, s, p)))
            key = mix(keys[d:d + 1] + times(draw, _A) + np.uint64(7))[0]
            u = lambda a, b, key=key: uniform(key + np.arange(a, b, dtype=np.uint64) * _C)
            paths[d].append(_Path(lattice, w, s, p, top, skip, u))

    word, slot, pick = lattice.walk(kind, mix(base))
    cut = np.searchsorted(word, np.append(first, len(kind)))
    root = -np.log(-np.log(uniform(mix(keys) + _A)))
    finish(0, range(len(kinds)), place[word], slot, pick, cut, [(root[d], 0, None) for d in range(len(kinds))])
    for draw in range(1, k):
        docs, prefix, starts, start_words = [], [], [], []
        for d, own in enumerate(paths):
            if len(own) < draw or not counts[d]:
                continue
            bests = [p.best(lattice) for p in own]
            j = max(range(len(own)), key=lambda j: bests[j][0])
            top, t = bests[j]
            if np.isneginf(top):
                continue
            p = own[j]
            taken = used[d].setdefault((j, t), [int(p.pick[t])])
            prob = np.exp(lattice.log[p.slot[t]].astype(float))
            prob[taken] = 0
            key = mix(keys[d:d + 1] + times(draw, _B) + np.uint64(3))
            new = int((uniform(key)[0] * prob.sum() >= np.cumsum(prob)).sum())
            new = min(new, int(np.flatnonzero(prob)[-1]))
            taken.append(new)
            prob[new] = 0
            rest = prob.sum()                       # what stays open at this node, below its bound
            phi = p.before[t] + np.log(rest) if rest > 0 else -np.inf
            p.open[t] = gumbel_below(np.array([phi]), top, uniform(key + _A))[0]
            head = (np.append(p.word[:t], p.word[t]), np.append(p.slot[:t], p.slot[t]), np.append(p.pick[:t], new))
            w, at = int(p.word[t]), int(p.slot[t]) + new + 1
            own_starts = kinds[d][w + 1:]
            words_ = np.arange(w + 1, counts[d])
            if lattice.left[p.slot[t]] > new + 1:
                own_starts, words_ = np.append(at, own_starts), np.append(w, words_)
            docs.append(d)
            prefix.append((top, t + 1, head))
            starts.append(own_starts)
            start_words.append(words_)
        if not docs:
            break
        sizes = np.array([len(s) for s in starts], np.int64)
        key = np.repeat(keys[docs] + times(draw, _C), sizes) + np.concatenate(start_words).astype(np.uint64) * _B
        word, slot, pick = lattice.walk(np.concatenate(starts).astype(np.int64), mix(key))
        edge = np.concatenate([[0], np.cumsum(sizes)])
        finish(draw, docs, np.concatenate(start_words)[word] if len(word) else word, slot, pick, np.searchsorted(word, edge), prefix)
    return [(own, max((p.best(lattice)[0] for p in own), default=-np.inf)) for own in paths]


def ids_of(lattice: Lattice, path: _Path) -> np.ndarray:
    ids = lattice.id.reshape(-1).take(path.cell)
    if len(ids) and ids.min() < 0:
        return np.concatenate([[i] if i >= 0 else lattice.vocab.byte_id[list(chr(-2 - i).encode())] for i in ids.tolist()]).astype(np.int32)
    return ids


def row_keys(ids) -> np.ndarray:
    return mix(np.array([0 if pd.isna(i) else int(i) + 1 for i in ids], np.int64).view(np.uint64) * _A)


def segmentations(lattice: Lattice, ids, texts: list[str], k: int):
    """Rows ``doc_id, rank, ids, log_prob, perturbed, inclusion`` of a batch of texts."""
    kinds = lattice.slots(texts)
    for d, (own, open_) in enumerate(sample_batch(lattice, kinds, row_keys(ids), k)):
        for r, p in enumerate(own):
            chance = 1.0 if np.isneginf(open_) else -np.expm1(-np.exp(min(p.total - open_, 700.0)))
            yield ids[d], r + 1, ids_of(lattice, p), float(p.total), float(p.top), float(chance)


def decode(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The text's UTF-8 bytes: the pieces' strings joined, space marks as spaces, the leading one dropped."""
    size = vocab.string_size[ids]
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(vocab.string_at[ids] - (ends - size), size)
    return vocab.strings[at].tobytes().removeprefix(b" ")


def sampled(docs: DataFrame, k: int = SAMPLES, path: str | None = None) -> DataFrame:
    """``k`` sampled segmentations of every text of ``docs(doc_id, text)``."""
    path = path or model_path()
    long_text_batches(docs.sparkSession)

    def run(batches):
        lattice = lattice_of(path)
        vocab = lattice.vocab
        for pdf in batches:
            ids, texts = [None if pd.isna(i) else int(i) for i in pdf["doc_id"]], list(pdf["text"])
            at = 0
            while at < len(texts):
                end, n = at, 0
                while end < len(texts) and (end == at or n + len(texts[end]) <= BATCH_CHARS):
                    n += len(texts[end])
                    end += 1
                rows = [(doc, r, len(x), zlib.crc32(x.astype("<u4").tobytes()), lp, g, q, zlib.crc32(decode(vocab, x)))
                        for doc, r, x, lp, g, q in segmentations(lattice, ids[at:end], texts[at:end], k)]
                yield pd.DataFrame(rows, columns=["doc_id", "rank", "n_pieces", "ids_crc32", "log_prob", "perturbed",
                                                  "inclusion", "decoded_crc32"]).astype({"doc_id": "Int64"})
                at = end

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, OUT)
