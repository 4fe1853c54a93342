"""Splitting oversized texts at natural boundaries.

A text is parsed into a tree: sections under headings, marked-up blocks, list items
and comments by their indent, paragraphs, lines. Only nodes that are too large by
themselves are opened, down to remarks, sentences, words and pre-tokens inside one
line; then siblings are merged bottom-up, left to right, up to the limit, the rest
of an opened node with what follows it, so no two neighbouring pieces would fit in
one. A heading stays with the first lines under it.

Sizes are tokens of byte_bpe_50k. Cuts fall on starts of pre-tokens, where the
tokens of a text are the tokens of its parts, so sizes are sums; a run of blanks at
the end of a piece, which may group otherwise there, is counted anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from throng.llm.bpe import Encoder, SharedEncoder, slices

# What ends a line, starts a section, a marked-up block, a list item or
# comment, and what parts remarks, sentences and words inside a line.
_LINE = re.compile("(?:[^\\r\\n\\u2028\\u2029]*)(?:\\r\\n|[\\n\\r\\u2028\\u2029]|\\Z)")
_HEADING = re.compile(r"(#{1,6})[ \t]")
_UNDERLINE = re.compile(r"(={3,}|-{3,})\s*\Z")
_FENCE = re.compile(r"[ \t]*(```+|~~~+)")
_TAG = re.compile(r"[ \t]*<(/?)(article|aside|blockquote|body|div|dl|figure|footer|header|html|li|main|nav|ol|p|pre|section|table|tbody|tr|ul)\b[^<>]*>", re.I)
_ITEM = re.compile(r"([ \t]*)(>(?:[ \t]*>)*[ \t]*)?(?:@|\[\d|[-*+•·][ \t]|\d+[.)][ \t])?")
_REMARK = re.compile(r"[ \t]+[·•][ \t]+")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]+")
_WORD = re.compile(r"(?<=\S)(?=\s)")
_INLINE = (_REMARK, _SENTENCE, _WORD)
#: Depth of the tree; what is nested deeper is no longer told apart by its depth.
DEEPEST = 200


def outline(text: str) -> list[tuple[int, int]]:
    """(start, depth) of every node of the tree of a text, in the order of the text.

    The root has depth 0; a node ends where the next one of no greater depth
    starts. Text of a node before its first child belongs to the node itself. The
    first node under a heading or a tag starts at these, if nothing else is
    between. Nodes nested deeper than DEEPEST become siblings.
    """
    nodes = [(0, 0)]
    around: list[tuple[str, int]] = []  # kind and rank of what is open at the line
    held: int | None = 0  # where headings, tags or blanks start that the next node takes in
    fresh, fence, underline = True, "", -1

    def leave(kinds: str, rank: int) -> None:
        while around and (around[-1][0] == "paragraph" or around[-1][0] in kinds and around[-1][1] >= rank):
            around.pop()

    def start(at: int, hold: bool = False) -> None:
        nonlocal held
        begin = at if held is None else held
        nodes.append((begin, min(len(around) + 1, DEEPEST)))
        held = begin if hold else None

    lines = [(m.start(), m.group()) for m in _LINE.finditer(text) if m.group()]
    for n, (at, line) in enumerate(lines):
        if n == underline:
            continue
        if fence:
            nodes.append((at, min(len(around) + 2, DEEPEST)))
            if line.strip().startswith(fence):
                fence, fresh = "", True
            continue
        if not line.strip():
            fresh = True
            continue
        item = _ITEM.match(line)
        indent = len(item.group(1).expandtabs(4)) + 2 * (item.group(2) or "").count(">")
        if level := _heading_level(line, lines[n + 1][1] if fresh and n + 1 < len(lines) else ""):
            leave("item", 0)
            leave("heading", level)
            start(at, hold=True)
            around.append(("heading", level))
            fresh, underline = True, -1 if line[0] == "#" else n + 1
        elif tag := _TAG.match(line):
            name = tag.group(2).lower()
            if not tag.group(1):
                leave("item", 0)
                start(at, hold=not line[tag.end() :].strip())
                if f"</{name}" not in line.lower():
                    around.append((name, 0))
            elif (name, 0) in around:
                while around.pop() != (name, 0):
                    pass
            fresh = True
        elif opening := _FENCE.match(line):
            leave("item", indent)
            start(at)
            fence = opening.group(1)[:3]
        elif item.end() > len(item.group(1)):
            leave("item", indent)
            start(at)
            around.append(("item", indent))
            fresh = False
        elif fresh:
            leave("item", indent)
            start(at)
            around.append(("paragraph", 0))
            fresh = False
        else:
            start(at)
    return nodes


def _heading_level(line: str, below: str) -> int:
    """Depth of the section that a line opens, by its signs or the line below; 0 if none."""
    if head := _HEADING.match(line):
        return len(head.group(1))
    under = _UNDERLINE.match(below)
    return 0 if not under or line[0] in " \t" else 1 if under.group(1)[0] == "=" else 2


class _Text:
    """One text with its pre-tokens; ``at`` has their starts and the text's end."""

    def __init__(self, text: str, at: np.ndarray, sizes: np.ndarray) -> None:
        self.text, self.at = text, np.append(at, len(text))
        self.tokens = np.concatenate([[0], np.cumsum(sizes)])

    def _places(self, chars: np.ndarray) -> np.ndarray:
        """The pre-token at each character, or the next if only blanks are between;
        -1 where there is none."""
        k = np.searchsorted(self.at, chars)
        for j in np.flatnonzero(self.at[k] != chars).tolist():
            if not self.text[chars[j] : self.at[k[j]]].isspace():
                k[j] = -1
        return k

    def tree(self) -> list[tuple[int, int]]:
        """(pre-token, depth) of the nodes of the outline that start at one."""
        nodes = outline(self.text)
        places = self._places(np.array([c for c, _ in nodes], dtype=np.int64)).tolist()
        return [(k, depth) for k, (_, depth) in zip(places, nodes, strict=True) if k >= 0]

    def pieces(self, budget: int) -> list[tuple[int, int]]:
        """The text as pieces of at most ``budget`` tokens; a single larger
        pre-token stays whole here."""
        nodes = self.tree()
        after = _next_of_no_greater_depth([d for _, d in nodes])
        return self._opened(nodes, after, 0, len(self.at) - 1, budget)

    def _opened(self, nodes: list[tuple[int, int]], after: list[int], node: int, hi: int, budget: int) -> list[tuple[int, int]]:
        """Pieces of an oversized node: its children, opened if need be, then merged."""
        total, units = self.tokens, []
        lo, child, last = nodes[node][0], node + 1, after[node]
        own = nodes[child][0] if child < last else hi
        if own > lo:
            units += [(lo, own)] if total[own] - total[lo] <= budget else self._inline(lo, own, budget)
        while child < last:
            a, follow = nodes[child][0], after[child]
            b = nodes[follow][0] if follow < last else hi
            if b > a:
                units += [(a, b)] if total[b] - total[a] <= budget else self._opened(nodes, after, child, b, budget)
            child = follow
        return self._merged(units, budget)

    def _inline(self, lo: int, hi: int, budget: int, level: int = 0) -> list[tuple[int, int]]:
        """Pieces of a stretch without structure of its own."""
        total = self.tokens
        if total[hi] - total[lo] <= budget or hi - lo == 1:
            return [(lo, hi)]
        if level == len(_INLINE):
            cuts = np.arange(lo + 1, hi)
        else:
            ends = [m.end() for m in _INLINE[level].finditer(self.text, int(self.at[lo]), int(self.at[hi]))]
            cuts = np.unique(self._places(np.array(ends, dtype=np.int64)))
            cuts = cuts[(cuts > lo) & (cuts < hi)]
            if not len(cuts):
                return self._inline(lo, hi, budget, level + 1)
        edges = np.concatenate([[lo], cuts, [hi]])
        over = np.diff(total[edges]) > budget
        if level == len(_INLINE) or not over.any():
            return self._merged(np.stack([edges[:-1], edges[1:]], axis=1).tolist(), budget)
        units: list[tuple[int, int]] = []
        for a, b, large in zip(edges[:-1].tolist(), edges[1:].tolist(), over.tolist(), strict=True):
            units += self._inline(a, b, budget, level + 1) if large else [(a, b)]
        return self._merged(units, budget)

    def _merged(self, units: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
        """Neighbours put together from the left as long as they stay in the budget."""
        edges = np.array([units[0][0], *(b for _, b in units)], dtype=np.int64)
        size = self.tokens[edges]
        out, i = [], 0
        while i < len(units):
            j = max(i + 1, int(np.searchsorted(size, size[i] + budget, side="right")) - 1)
            out.append((int(edges[i]), int(edges[j])))
            i = j
        return out


def _next_of_no_greater_depth(depths: list[int]) -> list[int]:
    """For each node the number of the next one that isn't inside it."""
    out, waiting = [len(depths)] * len(depths), []
    for k, d in enumerate(depths):
        while waiting and depths[waiting[-1]] >= d:
            out[waiting.pop()] = k
        waiting.append(k)
    return out


def _by_bytes(word: str, most: int) -> Iterator[int]:
    """Ends of parts of a string with at most ``most`` bytes each."""
    used = 0
    for k, ch in enumerate(word):
        n = len(ch.encode())
        if used and used + n > most:
            yield k
            used = 0
        used += n
    yield len(word)


def split_text(text: str, at: np.ndarray, sizes: np.ndarray, encoder: Encoder, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, own start, end, tokens) of each piece of one oversized text.

    [own start, end) of all pieces make up the text; [start, own start) is the end
    of the piece before, of at most ``overlap`` tokens.
    """
    doc = _Text(text, at, sizes)
    total, budget = doc.tokens, limit - overlap
    spans: list[tuple[int, int, int, int]] = []
    for lo, hi in doc.pieces(budget):
        a, b = int(doc.at[lo]), int(doc.at[hi])
        if total[hi] - total[lo] <= budget:
            spans.append((a, b, lo, hi))
        else:  # one pre-token beyond the budget: no more tokens than bytes
            cut = a
            for end in _by_bytes(text[a:b], budget):
                spans.append((cut, a + end, -1, -1))
                cut = a + end
    out, recount = [], []
    for k, (a, b, lo, hi) in enumerate(spans):
        start = a
        if k and overlap:
            p, _, plo, phi = spans[k - 1]
            if lo >= 0 and plo >= 0:
                j = max(plo, int(np.searchsorted(total, total[lo] - overlap)))
                words = [x for x in range(j, lo) if x == plo or text[doc.at[x]].isspace() or text[doc.at[x] - 1].isspace()]
                start = int(doc.at[words[0] if words else j])
            else:
                tail, used = a, 0
                while tail > p and (used := used + len(text[tail - 1].encode())) <= overlap:
                    tail -= 1
                start = tail
        if lo >= 0 and (start == a or doc.at[j := int(np.searchsorted(doc.at, start))] == start):
            first = int(np.searchsorted(doc.at, start))
            blank = b
            while b < len(text) and blank > start and text[blank - 1].isspace():
                blank -= 1
            if blank < b:
                hold = int(np.searchsorted(doc.at, blank))
                if doc.at[hold] == blank:
                    out.append([start, a, b, int(total[hold] - total[first])])
                    recount.append((k, text[blank:b], True))
                    continue
                out.append([start, a, b, 0])
                recount.append((k, text[start:b], False))
                continue
            out.append([start, a, b, int(total[hi] - total[first])])
        else:
            out.append([start, a, b, 0])
            recount.append((k, text[start:b], False))
    if recount:
        for (k, _, _), n in zip(recount, encoder.count([t for _, t, _ in recount]).tolist(), strict=True):
            out[k][3] += n
    for piece in out:
        if piece[3] > limit:  # a cut changed how the overlap groups: go without it
            piece[0] = piece[1]
            piece[3] = int(encoder.count([text[piece[1] : piece[2]]])[0])
    return [tuple(p) for p in out]


def split_documents(documents: DataFrame, limit: int = 512, overlap: int = 48, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The pieces of every text of more than ``limit`` tokens.

    Columns: the id, ``piece`` from 0, ``begin`` and ``finish`` (characters of the
    text), ``own`` (where the part begins that isn't overlap), ``tokens`` and
    ``text``. Texts within the limit, empty and null ones give no rows; repeated
    rows give their pieces again. Whole texts are read, of any length.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of limit")
    shared = SharedEncoder(documents.sparkSession, path)
    slim = documents.select(id_col, text_col)
    fields = [slim.schema[0], *(T.StructField(c, T.LongType()) for c in ("piece", "begin", "own", "finish", "tokens")), T.StructField("text", T.StringType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.get()
        for batch in batches:
            ids = batch.column(0)
            for first, texts in slices(batch.column(1)):
                word, at, per = encoder.pieces(texts)
                sizes = encoder.sizes[word]
                ends, chars = np.concatenate([[0], np.cumsum(per)]), 0
                total = np.concatenate([[0], np.cumsum(sizes)])
                rows, cut = [], []
                for k, text in enumerate(texts):
                    lo, hi = ends[k], ends[k + 1]
                    if total[hi] - total[lo] > limit:
                        done = split_text(text, at[lo:hi] - chars, sizes[lo:hi], encoder, limit, overlap)
                        rows += [(first + k, i, *p) for i, p in enumerate(done)]
                        cut += [text[p[0] : p[2]] for p in done]
                    chars += len(text)
                if rows:
                    table = np.array(rows, dtype=np.int64).T
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(table[0])), *(pa.array(c) for c in table[1:]), pa.array(cut, pa.string())], names=names)

    return slim.mapInArrow(run, T.StructType(fields))
