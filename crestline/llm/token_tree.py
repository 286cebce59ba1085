"""Edit-aware token counts: a segment tree of pre-token runs for each document.

A leaf is a run of whole pre-tokens of about ``LEAF_CHARS`` characters with its
token count; inner nodes hold the sums. Leaves end where a single space or line
feed stands between two other signs: with the byte-level pattern used here, a
pre-token always starts at that white space, whatever is before or after, so
the counts of the parts add up to that of the whole.

An edit finds its leaves by descending the character sums, re-encodes just
these (and a neighbour where the edit destroyed the boundary between them), and
updates the sums on the path.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

LEAF_CHARS = 384
DEEPEST = 64
#: Fixed value: the pre-token pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")
_ENCODERS: dict[bytes, object] = {}


def encoder(ranks: bytes):
    """The tokenizer of a rank file's content; built once in a process."""
    if ranks not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODERS[ranks] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[ranks]


def counter(ranks: bytes) -> Callable[[str], int]:
    """Number of tokens of a text; signs that aren't valid in UTF-8 are replaced."""
    encode = encoder(ranks).encode_ordinary
    return lambda text: len(encode(text))


def cuts(text: str, size: int = LEAF_CHARS) -> list[int]:
    """Ends of the leaves of a text, the last at its end; none for an empty text."""
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        at = m.start()
        out.append(at)
    return [*out, len(text)] if text else []


@dataclass(frozen=True)
class Node:
    chars: int
    tokens: int
    leaves: int
    depth: int
    left: Node | None = None
    right: Node | None = None


def _join(a: Node | None, b: Node | None) -> Node | None:
    if a is None or b is None:
        return a or b
    return Node(a.chars + b.chars, a.tokens + b.tokens, a.leaves + b.leaves, 1 + max(a.depth, b.depth), a, b)


def _balanced(leaves: list[Node]) -> Node | None:
    while len(leaves) > 1:
        leaves = [_join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def _split(node: Node | None, at: int) -> tuple[Node | None, Node | None]:
    """(leaves before, leaves from) the leaf that begins at or holds position ``at``."""
    if node is None or at >= node.chars:
        return node, None
    if at < 0 or node.left is None:
        return None, node
    if at < node.left.chars:
        a, b = _split(node.left, at)
        return a, _join(b, node.right)
    a, b = _split(node.right, at - node.left.chars)
    return _join(node.left, a), b


class TokenTree:
    """Text, tree and the work done: ``encoded`` counts the characters that were encoded."""

    def __init__(self, text: str, count: Callable[[str], int], leaves: Iterable[tuple[int, int]] | None = None, size: int = LEAF_CHARS):
        self.text, self.count, self.size, self.encoded = text, count, size, 0
        kept = [Node(c, t, 1, 1) for c, t in leaves] if leaves is not None else None
        self.root = _balanced(kept if kept is not None and sum(n.chars for n in kept) == len(text) else self._leaves(0, len(text)))

    def _leaves(self, start: int, end: int) -> list[Node]:
        part = self.text[start:end]
        self.encoded += len(part)
        out, at = [], 0
        for stop in cuts(part, self.size):
            out.append(Node(stop - at, self.count(part[at:stop]), 1, 1))
            at = stop
        return out

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    def leaves(self) -> list[tuple[int, int]]:
        """(characters, tokens) of all leaves in order."""
        out, open_ = [], [self.root] if self.root else []
        while open_:
            node = open_.pop()
            if node.left is None:
                out.append((node.chars, node.tokens))
            else:
                open_ += [node.right, node.left]
        return out

    def _sound(self, at: int) -> bool:
        """Whether leaves may meet at this position of the text."""
        return 0 < at < len(self.text) - 1 and _CUT.match(self.text, at) is not None

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from ``start`` up to ``end`` (clipped to the text)."""
        start = min(max(0, start), len(self.text))
        end = min(max(start, end), len(self.text))
        before, rest = _split(self.root, start)
        a = before.chars if before else 0
        after = rest
        # the leaf that holds the last changed character goes, too
        if rest is not None:
            _, after = _split(rest, max(end, start + 1) - a)
            if after is not None and after.chars > len(self.text) - end:
                after = self._drop_first(after)
        z = len(self.text) - (after.chars if after else 0)
        self.text = self.text[:start] + new + self.text[end:]
        z += len(new) - (end - start)
        while before is not None and not self._sound(a):
            last = self._last(before)
            a -= last.chars
            before = self._drop_last(before)
        while after is not None and not self._sound(z):
            z += self._first(after).chars
            after = self._drop_first(after)
        self.root = _join(_join(before, _balanced(self._leaves(a, z))), after)
        if self.root and self.root.depth > DEEPEST:
            self.root = _balanced([Node(c, t, 1, 1) for c, t in self.leaves()])

    @staticmethod
    def _first(node: Node) -> Node:
        while node.left is not None:
            node = node.left
        return node

    @staticmethod
    def _last(node: Node) -> Node:
        while node.right is not None:
            node = node.right
        return node

    @classmethod
    def _drop_first(cls, node: Node) -> Node | None:
        return None if node.left is None else _join(cls._drop_first(node.left), node.right)

    @classmethod
    def _drop_last(cls, node: Node) -> Node | None:
        return None if node.right is None else _join(node.left, cls._drop_last(node.right))
