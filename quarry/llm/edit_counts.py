"""Edit-aware token counting.

A document's text is kept as its pre-tokens in leaves of about ``LEAF`` each, under a segment tree
whose nodes hold the characters and tokens below them. An edit (start, removed, inserted) finds
its leaves by descending along the character sums, takes the touched pre-tokens and as many before
as the pattern may look ahead (``LOOK_AHEAD`` characters), and re-encodes from there. The pattern
never looks back, so matching may stop at the first new boundary that is an old boundary behind
the edit: from there on old and new pre-tokens are the same. Only changed leaves are rewritten and
only their sums and those above are updated. Counts of pre-tokens come from the BPE segment tree.

Special tokens in a text count as ordinary text. Null text counts as empty. Edits apply in order,
each to the text the ones before left; positions beyond the end mean the end. Rows map one to
one; null ids and repeated rows stay; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.bpe import BytePairCodec, codec
from quarry.llm.common import text_or_empty

LEAF = 64
#: Characters behind a pre-token that its match may have looked at ('ll, 've and 're need two,
#: the negative look-ahead of white space one).
LOOK_AHEAD = 2


class CountedText:
    """The segment tree of one document. ``text()``, ``n_tokens`` and ``edit`` are its interface."""

    def __init__(self, text: str, encoder: BytePairCodec):
        self.encoder = encoder
        self.n_reencoded = 0
        self.updates = 0
        self._load(encoder.pretokens(text))

    def count(self, token: str) -> int:
        return len(self.encoder.pretoken_ids(token)) // self.encoder.dtype.itemsize

    def _load(self, tokens: list[str]) -> None:
        self.leaves = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens, self.pieces = [0] * (2 * self.size), [0] * (2 * self.size), [0] * (2 * self.size)
        for k in range(len(self.leaves)):
            self._sum_leaf(k)
        for i in range(self.size - 1, 0, -1):
            self._sum_node(i)

    def _sum_leaf(self, k: int) -> None:
        leaf, i = self.leaves[k], self.size + k
        self.chars[i], self.tokens[i], self.pieces[i] = sum(map(len, leaf)), sum(map(self.count, leaf)), len(leaf)

    def _sum_node(self, i: int) -> None:
        for sums in (self.chars, self.tokens, self.pieces):
            sums[i] = sums[2 * i] + sums[2 * i + 1]

    def _update(self, first: int, last: int) -> None:
        """Sums of leaves first..last and of the nodes above them."""
        for k in range(first, last + 1):
            self._sum_leaf(k)
        a, b = (self.size + first) >> 1, (self.size + last) >> 1
        while a:
            for i in range(a, b + 1):
                self._sum_node(i)
                self.updates += 1
            a, b = a >> 1, b >> 1

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pretokens(self) -> int:
        return self.pieces[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(map("".join, self.leaves))

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) of the leaf that holds character ``at``; the last leaf
        with characters for the end."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return min(i - self.size, len(self.leaves) - 1), before

    def edit(self, start: int, removed: int, inserted: str) -> int:
        """Replace ``removed`` characters from ``start`` by ``inserted``; returns how many
        pre-tokens were encoded anew."""
        start = min(max(0, start), self.n_chars)
        stop = min(start + max(0, removed), self.n_chars)
        first, begin = self._leaf_at(max(0, start - LOOK_AHEAD - 1))
        # the first pre-token whose match may have seen the edit
        leaf = self.leaves[first]
        ends = list(accumulate(map(len, leaf), initial=begin))
        keep = 0
        while keep < len(leaf) and ends[keep + 1] + LOOK_AHEAD <= start - 1:
            keep += 1
        head, at = leaf[:keep], ends[keep]
        # old text from there through the edit, then leaf by leaf until the boundaries meet
        last, old, place = first, leaf[keep:], at
        old_ends = list(accumulate(map(len, old), initial=place))[1:]
        while True:
            while last + 1 < len(self.leaves) and (not old_ends or old_ends[-1] < stop):
                last += 1
                self._extend(old, old_ends, self.leaves[last], at)
            tail = "".join(old)
            fresh = tail[: start - at] + inserted + tail[stop - at :]
            tokens = self.encoder.pretokens(fresh)
            shift = len(inserted) - (stop - start)
            meet = self._meet(tokens, old_ends, at, start + len(inserted), shift, last + 1 < len(self.leaves))
            if meet is not None:
                break
            last += 1
            self._extend(old, old_ends, self.leaves[last], at)
        n_new, n_old = meet
        changed = head + tokens[:n_new] + old[n_old:]
        self.n_reencoded += n_new
        if len(changed) <= 8 * LEAF * (last - first + 1):
            per = -(-max(1, len(changed)) // (last - first + 1))
            for k in range(first, last + 1):
                self.leaves[k] = changed[(k - first) * per : (k - first + 1) * per]
            self._update(first, last)
        else:  # a very long insertion: lay the leaves out anew; counts of old pre-tokens are cached
            flat = [t for x in self.leaves[:first] for t in x] + changed + [t for x in self.leaves[last + 1 :] for t in x]
            self._load(flat)
        return n_new

    @staticmethod
    def _extend(old: list[str], old_ends: list[int], more: list[str], at: int) -> None:
        end = old_ends[-1] if old_ends else at
        for t in more:
            end += len(t)
            old.append(t)
            old_ends.append(end)

    @staticmethod
    def _meet(tokens: list[str], old_ends: list[int], at: int, edit_end: int, shift: int, more: bool) -> tuple[int, int] | None:
        """How many new and old pre-tokens lie before the first common boundary at or behind the
        edit. The last new ones may have ended early where the gathered text ends, so while leaves
        are left a boundary must lie ``LOOK_AHEAD + 1`` characters before that."""
        place, total = at, at + sum(map(len, tokens))
        limit = total - (LOOK_AHEAD + 1 if more else 0)
        ends = {e + shift: i + 1 for i, e in enumerate(old_ends)}
        for i, t in enumerate(tokens):
            place += len(t)
            if place >= edit_end and place <= limit and place in ends:
                return i + 1, ends[place]
        if not more:
            return len(tokens), len(old_ends)
        return None


def count_edits(docs: DataFrame, tokenizer_path: str, edits: Callable[[str], list[tuple[int, int, str]]]) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_pretokens, n_reencoded, edited_sha256 of each
    document, before and after the edits that ``edits(text)`` lists. A map; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path, special=False)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                tree = CountedText(text, c)
                before, pieces = tree.n_tokens, tree.n_pretokens
                todo = edits(text)
                for e in todo:
                    tree.edit(*e)
                rows.append((before, len(todo), tree.n_tokens, pieces, tree.n_reencoded, hashlib.sha256(tree.text().encode()).hexdigest()))
            kinds = [pa.int64()] * 5 + [pa.string()]
            names = ["n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_reencoded", "edited_sha256"]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=["doc_id", *names])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_pretokens long, n_reencoded long, edited_sha256 string"
    )


def review_edits(text: str) -> list[tuple[int, int, str]]:
    """Three edits as a reviewer makes them: drop seven characters a quarter in, repeat the first
    twelve in the middle, and put ``Edited `` for five at three quarters."""
    n = len(text)
    return [(n // 4, 7, ""), (n // 2, 0, text[:12]), (3 * n // 4, 5, "Edited ")]
