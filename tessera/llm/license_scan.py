"""License scan: fixed phrases, and an exact set-similarity join with notice templates.

Text is cut into blocks of words, half overlapping, so any passage of half a block lies whole
in one.  Block B meets template T if they share at least
ceil(threshold * |T|) of T's distinct words (containment).  Words are ordered by their
frequency in the whole corpus, rarest first:

* prefix filter: B and T must share a word among the first |T| - need + 1 of T and the first
  |B| - need + 1 of B;
* length filter: |B| >= need;
* positional filter: what is left of both after a shared word must still reach need.

The filters drop no pair that meets the threshold; what passes is counted exactly.  Words of
no template can't be shared, so B keeps only template words.  The templates are a parameter
and are broadcast: their size does not depend on the corpus.

A license may have several templates.  ``tell_apart`` is for templates so alike that the
threshold alone takes one license for another (CC BY-NC for CC BY-SA, say):

* a template of fewer than ``SHORT`` distinct words must be met by all of them;
* in a block, a template gives way to one of another license that shares so many words with
  it that its own text meets it, if that one is met better, or as well and is the larger
  (LGPL holds all words of GPL), unless the block has all words of the smaller one twice;
* templates share a block size only with others of their length, so a short notice is not
  put together from words far apart.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, with_keys

SHORT = 16
#: A-Z to a-z, other ASCII than letters and digits to space; bytes of other code points stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all code points from 128 on, A-Z lower-cased."""
    return text.translate(_FOLD).split()


class Templates:
    """Prefix index of the templates under a word order."""

    def __init__(self, templates: Sequence[tuple[str, frozenset]], threshold: float, frequency: Mapping[bytes, int],
                 tell_apart: bool = False):
        """``templates``: (label, words)."""
        vocabulary = sorted(set().union(*(w for _, w in templates)), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.labels = [label for label, _ in templates]
        self.sets = [frozenset(self.rank[w] for w in words) for _, words in templates]
        # the product may lie a rounding error above a whole number
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.near: list[list[int]] = [[] for _ in templates]
        if tell_apart:
            for t, s in enumerate(self.sets):
                self.near[t] = [u for u, o in enumerate(self.sets) if self.labels[u] != self.labels[t] and len(s & o) >= self.need[t]]
            self.need = [len(s) if len(s) < SHORT else n for s, n in zip(self.sets, self.need)]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (s, need) in enumerate(zip(self.sets, self.need)):
            for i, r in enumerate(sorted(s)[:len(s) - need + 1]):
                self.index.setdefault(r, []).append((t, i))
        self.prefix_words = frozenset(w for w, r in self.rank.items() if r in self.index)

    def meets(self, block: list[int]) -> list[tuple[int, float]]:
        """(template, containment) of a block given as its sorted template words."""
        shared, out, have = Counter(), [], None
        for j, r in enumerate(block):
            for t, i in self.index.get(r, ()):
                need = self.need[t]
                if j > len(block) - need:                    # length filter and B's prefix
                    continue
                if shared[t] + 1 + min(len(self.sets[t]) - i - 1, len(block) - j - 1) >= need:
                    shared[t] += 1
                else:
                    shared[t] = -len(block)                  # can't be reached any more
        for t, n in shared.items():
            if n > 0:
                have = have or frozenset(block)
                got = len(have & self.sets[t])
                if got >= self.need[t]:
                    out.append((t, got / len(self.sets[t])))
        return out

    def gives_way(self, t: int, met: dict[int, float], counts: Counter) -> bool:
        """Whether a template that is met is taken for a better one of another license."""
        for u in self.near[t]:
            if u in met and met[u] > met[t]:
                return True
            if u in met and met[u] == met[t] and len(self.sets[u]) > len(self.sets[t]) and any(counts[r] == 1 for r in self.sets[t]):
                return True
        return False


def scan(words: list[bytes], templates: Templates, block_words: int) -> list[tuple[int, int, float]]:
    """(template, first word of the block, containment) of every block that meets a template,
    by template and place."""
    if templates.prefix_words.isdisjoint(words):
        return []
    step = max(1, block_words // 2)
    last = max(0, -(-(len(words) - block_words) // step))        # blocks 0 to last cover the text
    blocks = set()
    for i, w in enumerate(words):
        if w in templates.prefix_words:
            blocks.update(b for b in (i // step, i // step - 1) if 0 <= b <= last)
            if i // step > last:
                blocks.add(last)
    found = []
    for b in blocks:
        n = Counter(templates.rank[w] for w in words[b * step:b * step + block_words] if w in templates.rank)
        met = dict(templates.meets(sorted(n)))
        found += [(t, b * step, c) for t, c in met.items() if not templates.gives_way(t, met, n)]
    return sorted(found)


def best_of(found: list[tuple[str, int, float, int]], key) -> list[tuple[str, int, float, int]]:
    """(label, first word, containment, template words): of those with one ``key`` the one with
    the largest containment, then of the largest template, then the first."""
    best: dict = {}
    for f in found:
        k = key(f)
        if k not in best or (f[2], f[3], -f[1]) > (best[k][2], best[k][3], -best[k][1]):
            best[k] = f
    return sorted(best.values())


def phrase_places(words: list[bytes], phrases: list[tuple[tuple[bytes, ...], str]], starts: frozenset) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    if starts.isdisjoint(words):
        return []
    out = []
    for i, w in enumerate(words):
        if w in starts:
            out += [(i, label) for p, label in phrases if tuple(words[i:i + len(p)]) == p]
    return out


def word_frequency(rows: DataFrame, vocabulary: frozenset) -> dict[bytes, int]:
    """How often each template word stands in all texts (one number per template word)."""
    def run(batches):
        for b in batches:
            n: Counter = Counter()
            for t in b.column("text").to_pylist():
                n.update(filter(vocabulary.__contains__, tokens(t)))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())],
                                                 ["word", "n"])
    counts = rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n"))
    return {bytes(w): n for w, n in counts.collect()}


def indexes(templates: Mapping[str, str | Sequence[str]], threshold: float, block_words: int, tell_apart: bool,
            frequency: Mapping[bytes, int]) -> list[tuple[int, Templates]]:
    """(block size, its templates): one size for all, or with ``tell_apart`` sizes doubling from
    ``block_words`` on, at least twice the words of a template."""
    listed = [(label, tokens(t.encode())) for label, ts in sorted(templates.items()) for t in ([ts] if isinstance(ts, str) else ts)]
    groups: dict[int, list] = {}
    longest = max((len(words) for _, words in listed), default=0)
    for label, words in listed:
        if words:
            block = block_words if tell_apart else max(block_words, 2 * longest)
            while block < 2 * len(words):
                block *= 2
            groups.setdefault(block, []).append((label, frozenset(words)))
    return [(block, Templates(g, threshold, frequency, tell_apart)) for block, g in sorted(groups.items())]


def license_scan(docs: DataFrame, phrases: Mapping[str, str], templates: Mapping[str, str | Sequence[str]], threshold: float = 0.8,
                 block_words: int = 48, tell_apart: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, n_words, places, notices, blocks) per input row.

    places: array of (word, label), every place of a phrase (phrase -> label); notices: array of
    (label, word, containment), each license found with its best block (of the largest
    containment, then of the largest template, then the first); blocks: the best of every
    block that meets a template of a label, by label and word.
    Null text is empty and has none; texts of any length are scanned whole.  Repeated rows
    are scanned each; an empty table gives an empty result; other columns are not read.
    """
    rows = with_keys(docs, id_col, text_col)
    flat = [(tuple(tokens(p.encode())), label) for p, label in sorted(phrases.items())]
    starts = frozenset(p[0] for p, _ in flat if p)
    vocabulary = frozenset(w for ts in templates.values() for t in ([ts] if isinstance(ts, str) else ts) for w in tokens(t.encode()))
    index = indexes(templates, threshold, block_words, tell_apart, word_frequency(rows, vocabulary))

    def run(c):
        def rows_of(found):
            return [{"label": label, "word": i, "containment": x} for label, i, x, _ in found]
        n, places, notices, blocks = [], [], [], []
        for t in c["text"].to_pylist():
            w = tokens(t)
            n.append(len(w))
            places.append([{"word": i, "label": x} for i, x in phrase_places(w, flat, starts)])
            found = [(x.labels[k], i, c, len(x.sets[k])) for block, x in index for k, i, c in scan(w, x, block)]
            notices.append(rows_of(best_of(found, lambda f: f[0])))
            blocks.append(rows_of(best_of(found, lambda f: f[:2])))
        kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("containment", pa.float64())]))
        return {"id": c["id"], "th": c["th"], "n_words": pa.array(n, pa.int64()),
                "places": pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                "notices": pa.array(notices, kind), "blocks": pa.array(blocks, kind)}
    return map_batches(rows, run, "id long, th long, n_words long, places array<struct<word: long, label: string>>, "
                                  "notices array<struct<label: string, word: long, containment: double>>, "
                                  "blocks array<struct<label: string, word: long, containment: double>>")
