"""Many entries against many pages in one pass: a token automaton that texts run through.

The entries' words form a trie with failure links (Aho-Corasick), held as flat
arrays: transitions sorted by (state, word), the failure of each state, and the
next shorter entry that ends where a state ends. All pages of an Arrow batch take
their n-th step together. Texts stay where they are read: nothing is exploded to
words and nothing but the entries, whose size is checked, is sent.

Beyond ENTRIES rows or ENTRY_BYTES bytes of entries the join of `match_dictionary`
gives the same rows.

Defined results: a null text has no pages; entries without a word match nothing;
entries that are equal, contain each other or overlap are all found, at every
place; a match never crosses a page; repeated rows of either table count each.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import lots
from ..functions.text import SPACE, match_form, tokens
from ..session import is_small
from ..sources.documents import WORDS_PER_PAGE
from ..sources.documents import words as document_words
from .match import match_dictionary

ENTRIES, ENTRY_BYTES = 200_000, 32 << 20
#: Pages that run together.
PAGES = 4096


class Automaton:
    def __init__(self, entries: list[list[str]]):
        self.ids: dict[str, int] = {}
        children: list[dict[int, int]] = [{}]
        ends: dict[int, list[int]] = {}
        for e, words in enumerate(entries):
            node = 0
            for w in words:
                i = self.ids.setdefault(w, len(self.ids))
                if i not in children[node]:
                    children[node][i] = len(children)
                    children.append({})
                node = children[node][i]
            if words:
                ends.setdefault(node, []).append(e)
        n = len(children)
        self.fail, self.link, self.out = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        todo = deque([0])
        while todo:
            node = todo.popleft()
            for i, child in children[node].items():
                back = self.fail[node]
                while back and i not in children[back]:
                    back = self.fail[back]
                self.fail[child] = children[back].get(i, 0) if node else 0
                self.link[child] = self.out[self.fail[child]]
                self.out[child] = child if child in ends else self.link[child]
                todo.append(child)
        self.width = len(self.ids) + 1
        flat = sorted((node * self.width + i, child) for node, kids in enumerate(children) for i, child in kids.items())
        self.keys, self.child = (np.array([x[k] for x in flat], np.int64) for k in (0, 1))
        sizes = np.array([len(ends.get(s, ())) for s in range(n)], np.int64)
        self.first = np.r_[0, np.cumsum(sizes)]
        self.entries = np.array([e for s in range(n) for e in ends.get(s, ())], np.int64)

    def numbered(self, words: list[str]) -> np.ndarray:
        """Words as numbers, -1 for those of no entry."""
        get = self.ids.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def run(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(page, last word, entry) of all matches; steps: a row of numbered words a page, -1 behind its end."""
        state = np.zeros(len(steps), np.int64)
        pages, lasts, nodes = [], [], []
        for j in range(steps.shape[1]):
            word = steps[:, j]
            state[word < 0] = 0
            todo = np.flatnonzero(word >= 0)
            while len(todo):
                key = state[todo] * self.width + word[todo]
                at = np.searchsorted(self.keys, key)
                ok = at < len(self.keys)
                ok[ok] = self.keys[at[ok]] == key[ok]
                state[todo[ok]] = self.child[at[ok]]
                todo = todo[~ok]
                # At the root there is nothing shorter to fall back to.
                todo = todo[state[todo] > 0]
                state[todo] = self.fail[state[todo]]
            node = self.out[state]
            here = np.flatnonzero(node)
            while len(here):
                pages.append(here)
                lasts.append(np.full(len(here), j))
                nodes.append(node[here])
                node[here] = self.link[node[here]]
                here = here[node[here] > 0]
        page, last, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pages, lasts, nodes))
        times = self.first[node + 1] - self.first[node]
        pick = np.repeat(self.first[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(page, times), np.repeat(last, times), self.entries[pick]


def _paged(a: Automaton, texts: list[list[str]], per_page: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, page in the text, last word, entry) of matches, in lots of pages; texts are lists of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = a.numbered([w for t in texts for w in t])
    count = -(-sizes // per_page)
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(sizes) - sizes)[text] + number * per_page
    length = np.minimum(sizes[text] - number * per_page, per_page)
    for at in range(0, len(text), PAGES):
        own = slice(at, at + PAGES)
        place = start[own, None] + np.arange(per_page)
        inside = np.arange(per_page) < length[own, None]
        steps = np.where(inside, flat[np.where(inside, place, 0)], -1)
        page, last, entry = a.run(steps)
        yield text[own][page], number[own][page], last, entry


def _prepared(dictionary: DataFrame, text_col: str) -> tuple[pa.Table, Automaton] | None:
    """The entries and their automaton, unless they are too many."""
    d = dictionary.withColumn("_w", tokens(F.col(text_col)))
    if not is_small(d, ENTRIES, ENTRY_BYTES):
        return None
    table = d.toArrow()
    words = [w or [] for w in table.column("_w").to_pylist()]
    table = table.append_column("n", pa.array([len(w) for w in words], pa.int32())).append_column("gram", pa.array([" ".join(w) for w in words], pa.string()))
    return table.drop_columns(["_w"]), Automaton(words)


def _split(documents: DataFrame, with_words: bool = False) -> DataFrame:
    """Texts in lower case, whose words need no more than a cut at white space; where other white space than the cut's four characters stands, lists of words and of their match forms."""
    words = lambda text: F.array_remove(F.split(text, "[ \t\n\r]+"), "")
    odd = F.col("text").rlike(SPACE.replace(r"\s", r"\f\x0b\x1c-\x1f"))
    more = [F.when(~odd, F.col("text")).alias("_text"), F.when(odd, words(F.col("text"))).alias("_words")] if with_words else []
    return documents.select("doc_id", F.when(~odd, F.lower("text")).alias("_low"), F.when(odd, F.transform(words(F.col("text")), match_form)).alias("_forms"), *more)


def _lists(b: pa.RecordBatch, at: int) -> list[list[str]]:
    """Words out of a column of texts and one of lists."""
    return [t.split() if t is not None else w or [] for t, w in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist())]


def match_texts(documents: DataFrame, dictionary: DataFrame, *, text_col: str = "entity_text", per_page: int = WORDS_PER_PAGE) -> DataFrame:
    """Every place where a dictionary text stands in documents (doc_id, text): doc_id, page_number, word_idx, n, gram and the dictionary's columns."""
    own = [c for c in dictionary.columns if c != "doc_id"]
    got = _prepared(dictionary, text_col)
    if got is None:
        return match_dictionary(document_words(documents, per_page), dictionary, text_col=text_col).select("doc_id", "page_number", "word_idx", "n", "gram", *own)
    held = documents.sparkSession.sparkContext.broadcast(got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, a = held.value
        columns = [table.column(c).combine_chunks() for c in ("n", "gram", *own)]
        sizes = table.column("n").to_numpy()
        for b in lots(batches, 1):
            for text, number, last, entry in _paged(a, _lists(b, 1), per_page):
                first = last - sizes[entry] + 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array((number + 1).astype(np.int32)), pa.array(first.astype(np.int32)), *(c.take(pa.array(entry)) for c in columns)], names=["doc_id", "page_number", "word_idx", "n", "gram", *own])

    rows = _split(documents)
    ddl = [f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", "page_number int", "word_idx int", "n int", "gram string", *(f"`{c}` {dictionary.schema[c].dataType.simpleString()}" for c in own)]
    return rows.mapInArrow(run, ", ".join(ddl))


def _piece(words: list[str], hits: list[tuple[int, int, str]]) -> list[str]:
    """Words of a page with the hits (first, -length, replacement) in their place; the earliest, then the longest speaks."""
    out: list[str] = []
    cover: dict[int, tuple[int, int, str]] = {}
    for hit in sorted(hits, reverse=True):
        for i in range(hit[0], hit[0] - hit[1]):
            cover[i] = hit
    for i, w in enumerate(words):
        hit = cover.get(i)
        piece = w if hit is None else hit[2] if hit[0] == i else ""
        if piece:
            out.append(piece)
    return out


def mask_texts(documents: DataFrame, dictionary: DataFrame, *, text_col: str = "entity_text", replacement_col: str = "replacement", per_page: int = WORDS_PER_PAGE) -> DataFrame:
    """(doc_id, page_number, masked_text, occurrences, remaining) of each page: matched, masked and run through the automaton again, in one pass.

    `remaining` counts entries that stand in the masked words; a replacement that is an entry counts.
    """
    got = _prepared(dictionary.select(text_col, F.coalesce(F.col(replacement_col), F.lit("")).alias("replacement")), text_col)
    if got is None:
        raise ValueError(f"more than {ENTRIES} entries or {ENTRY_BYTES} bytes: use match_texts and mask.mask_words")
    held = documents.sparkSession.sparkContext.broadcast(got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, a = held.value
        sizes, new = table.column("n").to_numpy(), table.column("replacement").to_pylist()
        for b in lots(batches, 1):
            hits: dict[tuple[int, int], list] = {}
            for text, number, last, entry in _paged(a, _lists(b, 1), per_page):
                for t, p, e, x in zip(text.tolist(), number.tolist(), last.tolist(), entry.tolist()):
                    hits.setdefault((t, p), []).append((e - int(sizes[x]) + 1, -int(sizes[x]), new[x]))
            rows, masked = [], []
            for t, words in enumerate(_lists(b, 3)):
                for p in range(-(-len(words) // per_page)):
                    page = words[p * per_page : (p + 1) * per_page]
                    found = hits.get((t, p), [])
                    masked.append(_piece(page, found) if found else page)
                    rows.append((t, p + 1, len(found)))
            left = np.zeros(len(rows), np.int64)
            forms = [[w.lower() for piece in m for w in piece.split()] if r[2] else [] for r, m in zip(rows, masked)]
            for row, _, _, _ in _paged(a, forms, max(1, *map(len, forms), 1)):
                np.add.at(left, row, 1)
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array([" ".join(m) for m in masked], pa.string()), pa.array(cols[2], pa.int64()), pa.array(left)], names=["doc_id", "page_number", "masked_text", "occurrences", "remaining"])

    rows = _split(documents, with_words=True)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, page_number int, masked_text string, occurrences long, remaining long")
