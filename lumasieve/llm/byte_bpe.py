"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each merge rank that occurs in a pre-token has a bucket of linked-list positions. Two levels of bitmaps tell which
buckets are filled: find-first-set on the summary gives a word, find-first-set on the word the lowest rank. Positions
whose pair has changed since they were queued are stale and skipped. A merge costs constant time, so a pre-token of n
bytes takes time in proportion to n, however long it is. A merged pair only forms pairs of later ranks (checked on
loading), so a whole bucket is taken at once, its positions from left to right.
"""

from __future__ import annotations

import json

import regex

WORD = 256
#: Pre-tokens kept with their ids, and the longest kept; when full, the store starts anew.
KEPT, KEPT_CHARS = 1 << 17, 256

# Fixed value: how byte-level BPE splits text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _byte_marks() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves,
    the others for the characters from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class ByteBpe:
    def __init__(self, vocabulary: bytes):
        """vocabulary: the content of a tokenizer file of byte-level BPE (JSON with model.vocab and model.merges)."""
        model = json.loads(vocabulary)["model"]
        vocab, marks = model["vocab"], _byte_marks()
        self.of_byte = [vocab[marks[b]] for b in range(256)]
        self.pairs: dict[int, tuple[int, int]] = {}
        first_rank = dict.fromkeys(self.of_byte, -1)
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, new = vocab[left], vocab[right], vocab[left + right]
            if max(first_rank[a], first_rank[b]) >= rank:
                raise ValueError("a merge comes before the merge that makes its parts")
            first_rank.setdefault(new, rank)
            self.pairs.setdefault(a << 32 | b, (rank, new))
        back = {m: b for b, m in marks.items()}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.split = regex.compile(SPLIT).findall
        self.kept: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        get = self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        summary = 0
        for i in range(n - 1):
            if hit := get(ids[i] << 32 | ids[i + 1]):
                rank = hit[0]
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    w = rank // WORD
                    words[w] = words.get(w, 0) | 1 << rank % WORD
                    summary |= 1 << w
        while summary:
            w = (summary & -summary).bit_length() - 1
            word = words[w]
            rank = w * WORD + (word & -word).bit_length() - 1
            word &= word - 1
            words[w] = word
            if not word:
                summary &= summary - 1
            places = buckets.pop(rank)
            if len(places) > 1:
                places.sort()
            for i in places:
                j = after[i]
                if ids[i] < 0 or j >= n:
                    continue
                hit = get(ids[i] << 32 | ids[j])
                if not hit or hit[0] != rank:
                    continue
                ids[i], ids[j] = hit[1], -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                for p, q in ((i, k), (before[i], i)):
                    if p >= 0 and q < n and (new := get(ids[p] << 32 | ids[q])):
                        r = new[0]
                        if r in buckets:
                            buckets[r].append(p)
                        else:
                            buckets[r] = [p]
                            v = r // WORD
                            words[v] = words.get(v, 0) | 1 << r % WORD
                            summary |= 1 << v
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        kept = self.kept
        for piece in self.split(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode()
