"""Byte-pair merging compiled, on demand, into a deterministic transducer.

Reading a word byte by byte, the encoding of every prefix ends in exactly one
token: the token that spells the prefix's last bytes and stays apart from the
last token before it. So all that later bytes can depend on is, for each place
from which a vocabulary token may still be growing, (trie node of the bytes
since, last token before, tokens so far relative to now). That set is a state;
there are finitely many. A transition on a byte leads to the next state and
emits the change in the number of tokens, which sums to the token count.

States and transitions are made when first needed and kept in the process, up
to ``MAX_STATES``; beyond it the table starts anew (memory only, same counts).
"""

from __future__ import annotations

import json

MAX_STATES = 150_000
START = ((0, -1, 0),)   # at a word's beginning


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_json(path: str):
    """(token bytes by id, merge ranks by id pair, special strings) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, of = spec["model"], byte_alphabet()
    special = {a["content"] for a in spec.get("added_tokens", [])}
    ids = {bytes(of[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
    ranks = {}
    for k, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        ranks[ids[bytes(of[c] for c in a)], ids[bytes(of[c] for c in b)]] = k
    return ids, ranks, sorted(special)


class Transducer:
    def __init__(self, ids: dict[bytes, int], ranks: dict[tuple[int, int], int]):
        self.ids, self.ranks = ids, ranks
        self.of = {i: t for t, i in ids.items()}
        self.trie: list[dict[int, int]] = [{}]         # node -> byte -> node
        self.token = [-1]                              # node -> id of the token it spells
        made = {self.of[a] + self.of[b] for a, b in ranks}
        for t, i in ids.items():
            if len(t) > 1 and t not in made:
                continue                               # no merge makes it
            n = 0
            for b in t:
                if b not in self.trie[n]:
                    self.trie[n][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                n = self.trie[n][b]
            self.token[n] = i
        self.apart: dict[int, bool] = {}
        self._reset()

    def _reset(self):
        self.number: dict[tuple, int] = {START: 0}
        self.items: list[tuple] = [START]
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, word: bytes) -> list[int]:
        """Plain merging: the leftmost pair of least rank until none is left."""
        t = [self.ids[bytes((b,))] for b in word]
        get = self.ranks.get
        while len(t) > 1:
            r, i = min((get(p, 1 << 60), i) for i, p in enumerate(zip(t, t[1:])))
            if r == 1 << 60:
                break
            t[i:i + 2] = [self.ids[self.of[t[i]] + self.of[t[i + 1]]]]
        return t

    def stays_apart(self, a: int, b: int) -> bool:
        k = a << 32 | b
        v = self.apart.get(k)
        if v is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            v = self.apart[k] = self.merge(self.of[a] + self.of[b]) == [a, b]
        return v

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """Make the transition of a state on a byte: (next state, tokens emitted)."""
        grown, last, emitted = [], None, 0
        for node, before, rel in self.items[state]:    # longest first
            n = self.trie[node].get(byte)
            if n is None:
                continue
            grown.append((n, before, rel))
            tok = self.token[n]
            if last is None and tok >= 0 and (before < 0 or self.stays_apart(before, tok)):
                last, emitted = tok, rel + 1
        if last is None:
            raise ValueError("the vocabulary does not cover every byte")
        items = tuple((n, before, rel - emitted) for n, before, rel in grown if self.trie[n]) + ((0, last, 0),)
        s = self._state(items)
        self.next[state][byte] = s, emitted
        return s, emitted

    def _state(self, items: tuple) -> int:
        s = self.number.get(items)
        if s is None:
            s = self.number[items] = len(self.items)
            self.items.append(items)
            self.next.append({})
        return s

    def advance(self, items: tuple, data: bytes) -> tuple[tuple, int]:
        """From the state of these items over more bytes: (items of the state, tokens emitted)."""
        s, n = self._state(items), 0
        for at in range(0, len(data), 4096):
            if len(self.items) > MAX_STATES:
                items = self.items[s]
                self._reset()
                s = self._state(items)
            for b in data[at:at + 4096]:
                s, more = self.next[s].get(b) or self.compile(s, b)
                n += more
        return self.items[s], n

    def counts(self, words: list[bytes]) -> list[int]:
        """Tokens of each word; sorted words reuse the run over a shared prefix."""
        out, path, so_far, prev = [], [0], [0], b""
        for w in words:
            if len(self.items) > MAX_STATES:
                self._reset()
                path, so_far, prev = [0], [0], b""
            i, n = 0, min(len(prev), len(w))
            while i < n and prev[i] == w[i]:
                i += 1
            del path[i + 1:], so_far[i + 1:]
            s, c = path[-1], so_far[-1]
            nxt = self.next
            for b in w[i:]:
                step = nxt[s].get(b)
                if step is None:
                    step = self.compile(s, b)
                s = step[0]
                c += step[1]
                path.append(s)
                so_far.append(c)
            out.append(c)
            prev = w
        return out
