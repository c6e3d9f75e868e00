"""Token ids of whole texts from a public tokenizer file, at the cost of its distinct words.

A byte-level tokenizer cuts a text before every space that follows a character other than white space, so a
text's ids are the ids of its space-separated pieces in turn. Each worker encodes a piece once, many pieces in
one call, and keeps it for later batches under two 64-bit hashes, so that a piece seen before is never made a string;
a text where that cut isn't certain is encoded whole."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix

#: Pieces that a worker remembers; at this many it begins anew.
REMEMBERED = 2_000_000
#: Bytes of the longest piece that is remembered.
LONGEST = 64
#: Texts whose pieces may not be encoded apart: white space around a space, a space at the end, special tokens,
#: and the two characters that stand for "no space here" and for a line end below.
_SPACE = r"[\s\x0b\x{85}\pZ]"
_WHOLE = rf"{_SPACE} ({_SPACE}|$)|<\||[\x02\x03]"
_JOINT, _LINE = "\x02", "\x03"
_MARKS = string.punctuation
_WEIGHTS = [np.random.default_rng(seed).integers(0, 2**64, LONGEST + 1, dtype=np.uint64) | np.uint64(1) for seed in (1, 2)]


class Pieces:
    """Encoder with a memory of pieces; ids by piece code in one growing array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.begins = np.zeros(self.size, dtype=bool)  # ids whose text begins with a space
        for token, i in vocabulary.items():
            self.begins[i] = token.startswith("Ġ")
        self.line = vocabulary["Ċ"]
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks, self.codes = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.marks: dict[str, int] = {}
        self.ids, self.ends, self.used, self.count = np.zeros(1 << 20, dtype=np.uint16 if self.size <= 65536 else np.uint32), np.zeros(1 << 18, dtype=np.int64), 0, 0

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Codes of new entries with their ids."""
        n = len(lengths)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[self.count + 1 : self.count + n + 1] = self.used + np.cumsum(lengths)
        self.used, self.count = self.used + len(ids), self.count + n
        return np.arange(self.count - n, self.count)

    @staticmethod
    def _hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two independent hashes of each string, sums of its bytes by random weights of their places, and its length."""
        col = strings.cast(pa.large_string())
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1, offset=8 * col.offset)
        n = np.diff(offsets)
        data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
        place = np.minimum(np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], n), LONGEST)
        at, out = offsets - offsets[0], []
        with np.errstate(over="ignore"):
            for k, weights in enumerate(_WEIGHTS):
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(data * weights[place], dtype=np.uint64)])
                out.append(mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64), k))
        return out[0], out[1], n

    def _found(self, h: np.ndarray, check: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Codes of strings by their hashes, -1 of those not remembered."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where((self.keys[at] == h) & (self.checks[at] == check) & (n <= LONGEST), self.codes[at], -1)

    def _remember(self, h: np.ndarray, check: np.ndarray, n: np.ndarray, codes: np.ndarray) -> None:
        some = np.flatnonzero(n <= LONGEST)
        some = some[np.argsort(h[some])]
        at = np.searchsorted(self.keys, h[some])
        self.keys, self.checks, self.codes = np.insert(self.keys, at, h[some]), np.insert(self.checks, at, check[some]), np.insert(self.codes, at, codes[some].astype(np.int32))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.ids.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, int]:
        """Codes of words that begin with a space or with _JOINT; new ones are encoded, many to a call."""
        if not words:
            return {}
        hashes = self._hashes(pa.array(words, pa.large_string()))
        codes = self._found(*hashes)
        first = np.fromiter((w[0] == _JOINT for w in words), dtype=bool, count=len(words))
        for joint in (False, True):
            at = np.flatnonzero((codes < 0) & (first == joint))
            groups = [at[i : i + 400] for i in range(0, len(at), 400)]
            texts = ["".join("\n" + words[i][1:] if joint else words[i] for i in g) for g in groups]
            for g, ids in zip(groups, self.whole(texts), strict=True):
                cut = np.flatnonzero(ids == self.line if joint else self.begins[ids])
                if len(cut) != len(g):
                    raise RuntimeError("pieces and ids disagree")
                lengths = np.diff(np.append(cut, len(ids)))
                codes[g] = self._add(np.delete(ids, cut), lengths - 1) if joint else self._add(ids, lengths)
            self._remember(*(h[at] for h in hashes), codes[at])
        return dict(zip(words, codes.tolist(), strict=True))

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Codes of new pieces. Each begins with a space or with _JOINT; marks after a word are pieces of their own, since
        the tokenizer cuts there."""
        words, cut, other = {}, [], []
        for i, x in enumerate(pieces):
            t = x.rstrip(_MARKS)
            if len(t) > 1 and t[1:].isalnum():
                words[t] = None
                cut.append((i, t, _LINE + x[len(t) :] if t != x else None))
            else:
                other.append((i, x))
        code = self._words(list(words))
        out = np.zeros(len(pieces), dtype=np.int64)
        plain = [m for m in dict.fromkeys(m for _, _, m in cut if m) if m not in self.marks]
        odd = [x for _, x in other] + plain
        if odd:
            ids = self.whole(["\n" if x == " " + _LINE else x[1:] if x[0] in (_JOINT, _LINE) else x for x in odd])
            codes = self._add(np.concatenate(ids), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
            out[[i for i, _ in other]] = codes[: len(other)]
            self.marks.update(zip(plain, codes[len(other) :].tolist(), strict=True))
        alone = [(i, code[t]) for i, t, m in cut if not m]
        if alone:
            out[[i for i, _ in alone]] = [c for _, c in alone]
        both = [(i, code[t], self.marks[m]) for i, t, m in cut if m]
        if both:
            pairs = np.array([x[1:] for x in both], dtype=np.int64).reshape(-1)
            n = self.ends[pairs + 1] - self.ends[pairs]
            out[[x[0] for x in both]] = self._add(self._gather(pairs, n), n.reshape(-1, 2).sum(axis=1))
        whole = np.array([i for i, t, m in cut if not m], dtype=np.int64)  # words are remembered by themselves
        new = np.setdiff1d(np.arange(len(pieces)), whole)
        if len(new):
            self._remember(*self._hashes(pa.array([pieces[i] for i in new], pa.large_string())), out[new])
        return out

    def _gather(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        ends = np.cumsum(n)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[codes] - (ends - n), n)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(start of each text's ids with one end more, ids) of texts without nulls."""
        odd = np.asarray(pc.match_substring_regex(texts, _WHOLE)).astype(bool)
        even = texts.filter(pa.array(~odd))
        # a line end between other characters than white space is a piece of its own
        apart = pc.if_else(pc.match_substring_regex(even, rf"{_SPACE}\n|\n{_SPACE}"), even, pc.replace_substring(even, "\n", f" {_LINE} {_JOINT}"))
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(_JOINT, even.type), apart, pa.scalar("", even.type)), " ")
        starts = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        codes, starts = np.asarray(coded.indices), starts - starts[0]
        distinct = coded.dictionary
        local = pc.if_else(pc.starts_with(distinct, _JOINT), distinct, pc.binary_join_element_wise(pa.scalar(" ", distinct.type), distinct, pa.scalar("", distinct.type)))
        if self.count > REMEMBERED:
            self.forget()
        known = self._found(*self._hashes(local)) if len(local) else np.zeros(0, dtype=np.int64)
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            known[fresh] = self._learn(local.take(pa.array(fresh)).to_pylist())
        piece = known[codes] if len(codes) else np.zeros(0, dtype=np.int64)
        n = self.ends[piece + 1] - self.ends[piece]
        ids = self._gather(piece, n)
        ends = np.concatenate([[0], np.cumsum(n)])
        sizes = np.zeros(len(texts), dtype=np.int64)
        sizes[~odd] = np.diff(ends[starts])
        at = np.concatenate([[0], np.cumsum(sizes)])
        if not odd.any():
            return at, ids
        whole = self.whole(texts.filter(pa.array(odd)).to_pylist())
        sizes[odd] = [len(x) for x in whole]
        at = np.concatenate([[0], np.cumsum(sizes)])
        out, is_odd = np.empty(at[-1], dtype=ids.dtype), np.repeat(odd, sizes)
        out[~is_odd], out[is_odd] = ids, np.concatenate(whole)
        return at, out


_kept: dict[str, Pieces] = {}


def encoder(path: str) -> Pieces:
    """One for each worker process and tokenizer file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _kept:
        _kept[path] = Pieces(path)
    return _kept[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
