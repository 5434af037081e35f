"""Byte-pair encoding by a deterministic automaton over token sequences.

Every token is a state: the one reached by an arc with that token's label.  At first there are only
bytes, and any byte may follow any other.  Merge k of ``(u, v)`` into ``w`` then changes the arcs by
one gadget:

* ``w`` becomes a copy of state ``v`` as it stands,
* every state with an arc ``u`` gets an arc ``w`` (except ``u`` itself where ``u`` is ``v``: in a
  run of ``u`` the left pair merges first),
* state ``u`` loses its arc ``v``.

After the last merge the label sequences from the start are exactly the sequences that the merges
leave unchanged, one for each byte string.  The full arc table of fifty thousand states is never
laid out: a copy points to the state it was copied from, so whether an arc exists is answered by
stepping through the gadgets backwards, and answers are kept in a transition table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Regex, pre_tokenizers

#: Pre-split pattern of the byte-level vocabularies (a fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per worker with their token ids; later words are encoded each time.
CACHED_WORDS = 300_000
#: Arcs kept per worker in the transition table.
CACHED_ARCS = 300_000
#: Word endings of up to SHORT bytes kept per worker with the tokens that begin them.
SHORT, CACHED_ENDS = 7, 100_000
#: Up to this character the pre-split classes are written out, which the faster engine takes.
NEAR = 0x24F


def byte_letters() -> dict[str, int]:
    """The vocabulary files' letter for each byte: itself if printable, else 256 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _near_class(kind: str) -> str:
    return "".join(
        re.escape(chr(i)) for i in range(NEAR + 1) if unicodedata.category(chr(i))[0] == kind
    )


def _near_split() -> re.Pattern:
    letters, numbers, space = _near_class("L"), _near_class("N"), r"\t-\r \x85\xa0"
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+"
        rf"| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class MergeAutomaton:
    """``merges`` in order over ``tokens`` (byte string -> id)."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.labels = {i: t for t, i in tokens.items()}
        # state numbers are ids; of each: when it was made, and from which pair
        self.made = dict.fromkeys((tokens[bytes([b])] for b in range(256) if bytes([b]) in tokens), -1)
        self.pair: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.state: dict[bytes, int] = {self.labels[i]: i for i in self.made}
        self.arcs: dict[int, bool] = {}  # by both ids in one number
        for k, (left, right) in enumerate(merges):
            u, v, w = tokens[left], tokens[right], tokens[left + right]
            if w in self.made:
                raise ValueError(f"two merges make the token {left + right!r}")
            # A gadget on an arc that earlier merges have removed has no effect.
            if u in self.made and v in self.made and self._has(u, v, k):
                self.made[w], self.pair[w], self.merged[u, v] = k, (u, v), k
                self.state[left + right] = w
        self.ends: dict[bytes, list[tuple[int, int]]] = {}
        # every prefix of a label leads to its state, or to -1 on the way to longer ones
        self.prefixes: dict[bytes, int] = {}
        for label, token in self.state.items():
            for n in range(1, len(label)):
                self.prefixes.setdefault(label[:n], -1)
            self.prefixes[label] = token

    def _has(self, x: int, y: int, at: float) -> bool:
        """Whether state ``x`` has an arc ``y`` before merge ``at``."""
        made, pair, merged = self.made, self.pair, self.merged
        while True:
            if merged.get((x, y), at) < at:
                return False
            i, j = made[x], made[y]
            if i > j:  # x copied its second part's arcs
                x, at = pair[x][1], i
            elif j >= 0:  # y came where its first part was
                u, v = pair[y]
                if i == j:
                    x, y, at = v, u, i
                elif x == u == v:
                    return False
                else:
                    y, at = u, j
            else:
                return True

    def arc(self, x: int, y: int) -> bool:
        found = self.arcs.get(x << 32 | y)
        if found is None:
            found = self._has(x, y, float("inf"))
            if len(self.arcs) < CACHED_ARCS:
                self.arcs[x << 32 | y] = found
        return found

    def _ahead(self, word: bytes, start: int) -> list[tuple[int, int]]:
        """Tokens that begin at ``start``, shortest first, each with its end."""
        rest = word[start:] if len(word) - start <= SHORT else None
        if rest is not None and (known := self.ends.get(rest)) is not None:
            return [(t, start + n) for t, n in known]
        found, prefixes, end = [], self.prefixes, start + 1
        token = prefixes.get(word[start:end])
        while token is not None:
            if token >= 0:
                found.append((token, end))
            end += 1
            if end > len(word):
                break
            token = prefixes.get(word[start:end])
        if rest is not None and len(self.ends) < CACHED_ENDS:
            self.ends[rest] = [(t, e - start) for t, e in found]
        return found

    def encode(self, word: bytes) -> list[int]:
        """The ids on the only path that spells ``word``.

        Long arcs are tried first.  A prefix has one path, so an end that led nowhere is not tried
        again and the search is linear in the arcs that fit.
        """
        whole = self.state.get(word)
        if whole is not None and len(word) == 1:
            return [whole]
        last, n, tried = -1, len(word), set()
        path: list[tuple[int, list[tuple[int, int]]]] = []
        options = self._ahead(word, 0)
        while True:
            while options:
                token, end = options.pop()
                if end not in tried and (last < 0 or self.arc(last, token)):
                    break
            else:
                if not path:
                    raise ValueError(f"no tokens spell {word!r}")
                _, options = path.pop()
                last = path[-1][0] if path else -1
                continue
            tried.add(end)
            path.append((token, options))
            if end == n:
                return [t for t, _ in path]
            last, options = token, self._ahead(word, end)

    def decode(self, ids) -> bytes:
        """The labels of the arcs, one after the other."""
        return b"".join(map(self.labels.__getitem__, ids))


class _Words(dict):
    """Word -> its ids as bytes, filled on demand up to a bound."""

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.automaton.encode(word.encode()), "<i4").tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids


class Codec:
    """Text to ids and back for a byte-level vocabulary file (its JSON text)."""

    def __init__(self, vocabulary: str):
        parts = json.loads(vocabulary)
        model, letters = parts["model"], byte_letters()
        pre = parts["pre_tokenizer"] or {}
        plain = not parts["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex")
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if not plain or pre.get("add_prefix_space") or odd or model.get("ignore_merges"):
            raise ValueError("only plain byte-level vocabularies are known")

        def octets(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        added = parts["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in white space are not known")
        special = {t["content"]: t["id"] for t in added}
        tokens = {octets(t): i for t, i in model["vocab"].items() if t not in special}
        merges = [tuple(map(octets, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.automaton = MergeAutomaton(tokens, merges)
        self.special = {t: np.array([i], "<i4").tobytes() for t, i in special.items()}
        self.automaton.labels |= {i: t.encode() for t, i in special.items()}
        longest = sorted(special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if special else None
        self.words = _Words(self.automaton)
        self.far = re.compile(f"[^\\x00-{chr(NEAR)}]")
        self.near_split = _near_split().findall
        # elsewhere the letters of the library's own Unicode tables count, so it splits these texts
        self.far_split = pre_tokenizers.Split(Regex(SPLIT), behavior="isolated").pre_tokenize_str

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if self.special and part in self.special:
                out.append(self.special[part])
            else:
                far = self.far.search(part)
                words = [w for w, _ in self.far_split(part)] if far else self.near_split(part)
                out.extend(map(self.words.__getitem__, words))
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    """Compiled once per worker."""
    return Codec(vocabulary)
