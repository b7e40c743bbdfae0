"""Token ids of whole text columns with the tokenizers library.

A batch is cut at spaces and line feeds, its distinct pieces are encoded by the library (many pieces a call, with a
separator whose id marks their ends), and the rows' ids are gathered from them in numpy. An encoder that may keep some
bytes looks pieces that it has met before up instead of encoding them again. For the byte-level vocabulary a cut is exact where a single white space stands between other characters, so rows with runs of white space, or white
space other than these two, are encoded whole. The word vocabulary drops white space, so each cut is exact.

Strings of added tokens inside a text (such as end marks) are what the library's plain call makes of them: rows that hold
one are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkernel import flat

#: Pieces encoded in one string.
PER_STRING = 300
#: Strings a call; a call's full encodings take many times their ids' memory, so they are held for these only.
PER_CALL = 32


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold white space other than single spaces and line feeds between other characters."""
    narrow = np.zeros(256, dtype=bool)
    narrow[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
    ws = narrow[data]
    bad = ws & (data != 32) & (data != 10)
    bad[1:] |= ws[1:] & ws[:-1]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[np.isin(data[lead], (0xC2, 0xE1, 0xE2, 0xE3))]
    if len(lead):
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = pad[lead], pad[lead + 1], pad[lead + 2]
        wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        wide |= (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & (b == 0x81) | (a == 0xE3) & (b == 0x80)
        wide |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        bad[lead[wide]] = True
    odd, full = np.zeros(len(offsets) - 1, dtype=bool), offsets[1:] > offsets[:-1]
    if full.any():
        odd[full] = np.logical_or.reduceat(bad, offsets[:-1][full])
    return odd


#: A letter that every version of Unicode knows as one, also in lower case (so not U+0130), and a comma or full stop.
_TAIL = "[A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{12F}\\x{131}-\\x{24F}][,.]$"


class Encoder:
    def __init__(self, path: str, keep: int = 0):
        """keep: bytes of pieces and ids that may be kept from call to call."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        added = self.t.get_added_tokens_decoder().values()
        if any(a.normalized or a.lstrip or a.rstrip for a in added):
            raise ValueError("added tokens must be matched as they stand")
        self.added = sorted({a.content for a in added})
        self.keeps_space = len(self._ids(" ")) > 0
        self.mark = "\n" if self.keeps_space else "\x01"
        self.head = " " if self.keeps_space else ""
        self.mark_id, self.comma, self.stop = (self._one(x) for x in (self.mark, ",", "."))
        self.keep = keep
        self.kept: dict[str, tuple[pa.Array, np.ndarray, np.ndarray]] = {}

    def _ids(self, text: str) -> list[int]:
        return self.t.encode(text, add_special_tokens=False).ids

    def _one(self, text: str) -> int:
        ids = self._ids(text)
        if len(ids) != 1:
            raise ValueError(f"{text!r} must be one token")
        return ids[0]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and each text's number of them."""
        parts = list(self._encoded(texts))
        sizes = np.array([len(x) for x in parts], dtype=np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), sizes

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        for k in range(0, len(texts), PER_CALL):
            for e in self.t.encode_batch_fast(texts[k : k + PER_CALL], add_special_tokens=False):
                yield np.array(e.ids, dtype=np.uint32)

    def _joined(self, pieces: list[str], head: str) -> tuple[np.ndarray, np.ndarray]:
        """As _whole for pieces after head, many in one string between marks. Those that hold a mark, and empty ones,
        are encoded alone."""
        alone = np.array([not p or self.mark in p for p in pieces], dtype=bool)
        rest = [p for p in pieces if p and self.mark not in p]
        gap = self.mark if self.keeps_space else f" {self.mark} "
        strings = [head + (gap + head).join(rest[k : k + PER_STRING]) for k in range(0, len(rest), PER_STRING)]
        parts, sizes = [], np.zeros(len(pieces), dtype=np.int64)
        own = []
        for ids in self._encoded(strings):
            at = np.flatnonzero(ids == self.mark_id)
            own.append(np.diff(at, prepend=-1, append=len(ids)) - 1)
            parts.append(np.delete(ids, at))
        if own:
            sizes[~alone] = np.concatenate(own)  # fails if pieces and marks don't agree
        flat_ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if not alone.any():
            return flat_ids, sizes
        ids, n = self._whole([head + p for p, x in zip(pieces, alone.tolist(), strict=True) if x])
        sizes[alone] = n
        out = np.empty(int(sizes.sum()), dtype=np.uint32)
        from_alone = np.repeat(alone, sizes)
        out[from_alone], out[~from_alone] = ids, flat_ids
        return out, sizes

    def _known(self, pieces: pa.Array, head: str) -> tuple[np.ndarray, np.ndarray]:
        """As _joined for distinct pieces. What earlier calls have kept isn't encoded again; once it fills its half of
        `keep` (there are two heads), only this call's pieces stay."""
        if not self.keep:
            return self._joined(pieces.to_pylist(), head)
        none = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int32)
        held, ids, sizes = self.kept.get(head, none)
        at = pc.index_in(pieces, value_set=held)
        new = pieces.filter(at.is_null())
        own, own_sizes = self._joined(new.to_pylist(), head)
        index = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        index[at.is_null().to_numpy(zero_copy_only=False)] = len(held) + np.arange(len(new))
        every = pa.concat_arrays([held, new]), np.concatenate([ids, own]), np.concatenate([sizes, own_sizes.astype(np.int32)])
        out_sizes = every[2][index]
        out = _gather(every[1], every[2], index)
        fits = (x for x in (every, (pa.concat_arrays([pieces]), out, out_sizes), none) if sum(y.nbytes for y in x) <= self.keep // 2)
        self.kept[head] = next(fits)
        return out, out_sizes.astype(np.int64)

    def _table(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids and sizes of the distinct pieces. A comma or full stop after a letter is a token of its own; the pieces
        without it are fewer."""
        tail = pc.match_substring_regex(distinct, _TAIL)
        base = pc.if_else(tail, pc.utf8_slice_codeunits(distinct, 0, -1), distinct).dictionary_encode()
        ids, sizes = self._known(base.dictionary, self.head)
        of = base.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ended = tail.to_numpy(zero_copy_only=False).astype(bool)
        total = sizes[of] + ended
        place = np.concatenate([[0], np.cumsum(total)])
        out = np.empty(place[-1], dtype=np.uint32)
        mask = np.ones(place[-1], dtype=bool)
        last = place[1:][ended] - 1
        mask[last] = False
        out[last] = np.where(pc.ends_with(distinct, ",").to_numpy(zero_copy_only=False).astype(bool)[ended], self.comma, self.stop)
        out[mask] = _gather(ids, sizes, of)
        return out, total

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of all rows, one after the other, and the rows' bounds; null counts as empty."""
        column = column.cast(pa.large_string()).fill_null("")
        marked = np.zeros(len(column), dtype=bool)
        for content in self.added:
            # Added tokens are matched in the text as it stands, before it is normalized.
            marked |= pc.match_substring(column, content).to_numpy(zero_copy_only=False).astype(bool)
        if not marked.any():
            return self._cut(column)
        ids, bounds = self._cut(pc.if_else(pa.array(~marked), column, pa.scalar("", pa.large_string())))
        own, sizes = self._whole(column.filter(pa.array(marked)).to_pylist())
        total = np.diff(bounds)
        total[marked] = sizes
        out = np.empty(int(total.sum()), dtype=np.uint32)
        theirs = np.repeat(marked, total)
        out[theirs], out[~theirs] = own, ids
        return out, np.concatenate([[0], np.cumsum(total)])

    def _cut(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for rows (large strings) without added tokens."""
        n = len(column)
        data, offsets = flat(column)
        lo = int(offsets[0])
        odd = _odd_space(data[lo : int(offsets[-1])], offsets - lo) if self.keeps_space else np.zeros(n, dtype=bool)
        plain = pc.if_else(pa.array(~odd), column, pa.scalar("", pa.large_string())) if odd.any() else column
        # A line feed stays with the piece after it, which then follows no space; all other pieces but a row's first do.
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", " \n" if self.keeps_space else " "), " ")
        words = cut.flatten().dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        distinct = words.dictionary
        if not self.keeps_space:
            ids, sizes = self._table(distinct)
            place = np.concatenate([[0], np.cumsum(sizes[index])])
            return _gather(ids, sizes, index), place[bounds]
        # Line starts: the same table as the others', after the line feed, but bare.
        feed = pc.starts_with(distinct, "\n").to_numpy(zero_copy_only=False).astype(bool)
        first = index[bounds[:-1]]
        texts = distinct.take(pa.array(first)).to_pylist()
        lines = pc.utf8_slice_codeunits(distinct.filter(pa.array(feed)), 1)
        whole = column.filter(pa.array(odd)).to_pylist()
        ids, sizes = self._table(distinct.filter(pa.array(~feed)))
        bare, bare_sizes = self._known(lines, "")
        heads, head_sizes = self._joined([t.removeprefix("\n") for t in texts], "")
        rows, row_sizes = self._whole(whole)
        # One table of all: pieces after a space, lines (with their feed), row starts, rows encoded whole, nothing.
        starts_feed = np.array([t[:1] == "\n" for t in texts], dtype=bool)
        table = np.concatenate([ids, _after(self.mark_id, bare, bare_sizes, np.ones(len(lines), bool)), _after(self.mark_id, heads, head_sizes, starts_feed), rows])
        table_sizes = np.concatenate([sizes, bare_sizes + 1, head_sizes + starts_feed, row_sizes])
        to = np.empty(len(distinct), dtype=np.int64)
        to[~feed] = np.arange(len(sizes))
        to[feed] = len(sizes) + np.arange(len(lines))
        index = to[index]
        base = len(sizes) + len(lines)
        index[bounds[:-1]] = np.where(odd, base + n + np.cumsum(odd) - 1, base + np.arange(n))
        place = np.concatenate([[0], np.cumsum(table_sizes[index])])
        return _gather(table, table_sizes, index), place[bounds]


def _gather(ids: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The ids of the pieces index, one after the other; sizes: of all pieces, in their order in ids."""
    start = np.cumsum(sizes) - sizes
    count = sizes[index]
    ends = np.cumsum(count)
    pick = np.repeat(start[index] - (ends - count), count)
    pick += np.arange(len(pick))
    return ids[pick]


def _after(mark: int, ids: np.ndarray, sizes: np.ndarray, use: np.ndarray) -> np.ndarray:
    """ids with the mark before each piece that uses it."""
    return np.insert(ids, (np.cumsum(sizes) - sizes)[use], mark) if use.any() else ids


@cache
def encoder(path: str, keep: int = 0) -> Encoder:
    return Encoder(path, keep)
