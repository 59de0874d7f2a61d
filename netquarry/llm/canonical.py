"""Mapping freely typed names to the closest entry of a reference list.

Method: values are deduplicated and normalised; candidates come from an inverted
index of character n-grams over the reference list; they are scored by cosine
with inverse-frequency weights; the best one is accepted when its score reaches a
threshold and leads the runner-up by a margin.

Normalising takes off decoration (instance paths, bus indices, pad and direction
marks), splits words by separators and case, splits words written together and
mends typing errors by the lexicon of the reference list's own words, and writes
abbreviations out.  Decoration and abbreviations are learnt from the table
(``learn``): what stands before or after whole reference names, and what stands in
for one of their words, in at least a share of the distinct values.

Where a typed part may be several words, each reference is compared with the
words that suit it best; the search over references stops where a bound on the
score shows that no other can be among the best two.

The index of up to ``IN_TASK`` references is built inside the tasks (its size is
checked first).  A longer list is joined by the rarest grams of each value: so many
of them that a reference without any of these cannot reach the threshold less the
margin, which leaves the frequent grams out without losing a candidate.

Defined results
* null and empty values have no row; a value without letters or digits, and every
  value of an empty reference list, is unmatched (``ref_id`` -1, score 0);
* scores below the threshold less the margin decide nothing and are given as 0;
* equal scores of two references leave no margin, thus unmatched;
* repeated values are matched once; extra columns are not touched;
* a reference list of more than ``LEXICON`` different words is refused.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry import scratch

THRESHOLD = 0.70
MARGIN = 0.03
GRAM = 3
IN_TASK = 20_000
LEXICON = 200_000  # most words of references that a task may hold
FULL = 2_000  # most words of which every typing error is listed; errors of more are looked up by deletions
LEAST_VOTES, SHARE = 3, 0.0005  # what is learnt occurs in so many distinct values, and in such a share of them

_WORD = re.compile(r"[A-Z]+(?![a-z])[0-9]*|[A-Z]?[a-z0-9]+|[A-Z]+|[^\W_]+")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def without_index(text: str) -> str:
    """A name without the bracketed indices at its end, the last of which may lack its closing bracket."""
    end = len(text)
    while end:
        inner = end - 1 if text[end - 1] in "])>" else end
        begin = max(text.rfind(c, 0, inner) for c in "[<(")
        if begin < 0 or any(text.find(c, begin + 1, inner) >= 0 for c in "])>"):
            break
        end = begin
    return text[:end]


def one_error(word: str) -> set[str]:
    """Every string one typing error away: a letter left out, doubled, added, exchanged or two swapped."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b}
    out |= {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
    out |= {a + c + b[1:] for a, b in cuts if b for c in _ALPHABET}
    out |= {a + c + b for a, b in cuts for c in _ALPHABET}
    out.discard(word)
    return out


class Near(dict):
    """Words one typing error away from a string, found by common deletions; what was asked is remembered up to a bound."""

    def __init__(self, words: dict[str, set[str]]):
        super().__init__()
        self.words, self.keys = words, defaultdict(set)
        for w in words:
            for d in self._deletions(w):
                self.keys[d].add(w)

    @staticmethod
    def _deletions(word: str) -> set[str]:
        return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}

    def __missing__(self, typo: str) -> frozenset[str]:
        if len(self) > 300_000:
            self.clear()
        near = {w for d in self._deletions(typo) for w in self.keys.get(d, ())}
        # what was added or put in place of a letter is a letter
        near = {w for w in near if w != typo and distance(typo, w, 1) == 1 and all(c in _ALPHABET for c in Counter(typo) - Counter(w))}
        found = self[typo] = frozenset(x for w in near for x in self.words[w])
        return found

    def __contains__(self, typo) -> bool:
        return bool(self[typo])

    def get(self, typo, default=None):
        """The words, or the default if there are none."""
        return self[typo] or default


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or ``most`` + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = [], list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            cost = min(old[j] + 1, new[-1] + 1, old[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                cost = min(cost, older[j - 2] + 1)
            new.append(cost)
        older, old = old, new
        if min(old) > most:
            return most + 1
    return min(old[-1], most + 1)


@dataclass(frozen=True)
class Learnt:
    """What a table shows beside its reference list: words before and after names, and abbreviations."""

    heads: frozenset[tuple[str, ...]] = frozenset()
    tails: frozenset[tuple[str, ...]] = frozenset()
    abbreviations: dict[str, tuple[str, ...]] = field(default_factory=dict)


def typed_words(value: str) -> list[str]:
    """The words of a typed name by separators and case, bracketed indices off."""
    return [w.lower() for w in _WORD.findall(without_index(value.strip().strip("'`\"\\/")))]


class Normaliser:
    """Words of a typed name, by the lexicon of a reference list.

    A word comes with the confidence 0..1 that it is what the typed part means.
    """

    def __init__(self, words: set[str], learnt: Learnt = Learnt(), full: int = FULL):  # noqa: B008 - frozen
        lexicon = {w for w in words if w}
        self.learnt = learnt
        self.lexicon = sorted(w for w in lexicon if len(w) >= 3)
        self.by_size: dict[int, list[str]] = defaultdict(list)
        for w in self.lexicon:
            self.by_size[len(w)].append(w)
        exact = {w: {w} for w in lexicon}
        for short, meant in learnt.abbreviations.items():
            if short not in lexicon:
                exact[short] = {w for w in meant if w in lexicon}
        # an error in a word explains more than one in an abbreviation
        groups = [{f: ws for f, ws in exact.items() if len(f) >= 3 and (f in lexicon) == ours} for ours in (True, False)]
        self.exact, self.longest = exact, max(map(len, exact), default=0) + 1
        self.own, self.other = (self._listed(g) if len(lexicon) <= full else Near(g) for g in groups)
        self.repaired: dict[str, list[tuple[str, float]]] = {}
        self.errors: dict[str, int] = {}

    @staticmethod
    def _listed(forms: dict[str, set[str]]) -> dict[str, set[str]]:
        out: dict[str, set[str]] = defaultdict(set)
        for form, words in forms.items():
            for typo in one_error(form):
                out[typo] |= words
        return dict(out)

    def _near(self, part: str) -> tuple[set[str] | frozenset[str] | None, bool]:
        """(words that a part is one error away from, whether they are words and not abbreviations)."""
        if part in self.exact or len(part) < 2:
            return None, False
        found = self.own.get(part)
        if found and len(part) >= 3:
            return found, True
        found = self.other.get(part)
        # a short abbreviation may lose a letter, but must not be told from two letters
        return (found, False) if found and len(part) >= 3 else (None, False)

    def _repair(self, part: str) -> list[tuple[str, float]]:
        """All lexicon words closest to a part that no single error explains, and how sure that is.

        A word below eight letters may have half of them wrong, a longer one three.
        """
        if part not in self.repaired:
            best, found = 4, []
            if len(part) >= 3 and part.isalpha():
                for size in range(max(3, len(part) - 3), len(part) + 4):
                    for w in self.by_size.get(size, ()):
                        most = min(best, len(w) // 2 if len(w) < 8 else 3)
                        if (d := distance(part, w, most)) <= most:
                            if d < best:
                                best, found = d, []
                            if d == best:
                                found.append(w)
            if len(self.repaired) > 200_000:
                self.repaired.clear()
                self.errors.clear()
            self.errors[part] = best
            self.repaired[part] = [(w, 1 - best / len(w)) for w in sorted(found)] or [(part, 1.0)]
        return self.repaired[part]

    def _segment(self, token: str) -> list[list[tuple[str, float]]]:
        """Words whose forms, joined, are the token: fewest errors, then fewest words."""
        n = len(token)
        best: list[tuple[float, tuple] | None] = [None] * (n + 1)
        best[0] = (0.0, ())
        for end in range(1, n + 1):
            for begin in range(max(0, end - self.longest), end):
                before = best[begin]
                if before is None:
                    continue
                part = token[begin:end]
                if part in self.exact:
                    # a lone letter or digit may only close a word
                    if len(part) == 1 and end < n:
                        continue
                    cost, kind = (0.3 if len(part) > 1 else 0.25), 0
                else:
                    near, own = self._near(part)
                    if near:
                        cost, kind = 1.3 + 0.3 * (not own) + 0.4 * (len(part) < 4), 0
                    elif len(part) > 2:
                        cost, kind = 2.0 + 0.15 * len(part), 1
                    else:
                        continue
                if best[end] is None or before[0] + cost < best[end][0]:
                    best[end] = (before[0] + cost, (before[1], begin, end, kind))
            if end - self.longest > 0 or best[end] is None:
                whole = (2.0 + 0.15 * end, ((), 0, end, 1))
                if best[end] is None or whole[0] < best[end][0]:
                    best[end] = whole
        if best[n][0] > 2.2 and (whole := self._repair(token))[0][0] != token:
            if 1.2 + 0.7 * self.errors[token] < best[n][0]:
                return [whole]
        out, link = [], best[n][1]
        while link:
            link, begin, end, kind = link
            part = token[begin:end]
            out.append(self._repair(part) if kind else [(w, 1.0) for w in sorted(self.exact.get(part) or self._near(part)[0])])
        return out[::-1]

    def tokens(self, value: str) -> list[list[tuple[str, float, str]]]:
        """The parts of a value, each with the words that it may be, their confidence and what was typed."""
        joined: list[str] = []
        for w in typed_words(value):  # a lone digit or letter run cut off a word by its case, as in I2C
            if joined and (joined[-1] + w) in self.exact and w not in self.exact:
                joined[-1] += w
            else:
                joined.append(w)
        # learnt decoration, the longest first, as long as something is left
        for affixes, cut in ((self.learnt.heads, lambda x, k: (tuple(x[:k]), x[k:])), (self.learnt.tails, lambda x, k: (tuple(x[-k:]), x[:-k]))):
            again = True
            while again:
                again = False
                for k in range(min(3, len(joined) - 1), 0, -1):
                    affix, rest = cut(joined, k)
                    if affix in affixes:
                        joined, again = rest, True
                        break
        return [[(w, c, token) for w, c in choice] for token in joined for choice in self._segment(token)]


def in_order(short: str, word: str) -> bool:
    """Whether a word has the letters of a short form in their order."""
    rest = iter(word)
    return all(c in rest for c in short)


def explain(words: list[str], names: dict[tuple[str, ...], str], by_rest: dict[tuple[str, ...], list[str]]) -> Iterator[tuple[str, str, str, float]]:
    """(kind, what, meaning, votes) of one value's words: decoration of a reference, or one word that stands in for another.

    ``names`` are the references' sorted words, ``by_rest`` what is missing where
    one of their words is left out.
    """
    n = len(words)
    for i in range(min(4, n)):
        for j in range(n, max(i, n - 3), -1):
            if (i or j < n) and tuple(sorted(words[i:j])) in names:
                if i:
                    yield "head", " ".join(words[:i]), "", 1.0
                if j < n:
                    yield "tail", " ".join(words[j:]), "", 1.0
                return
    for i in range(n):
        missing = by_rest.get(tuple(sorted(words[:i] + words[i + 1 :])), ())
        for w in missing if n > 1 else ():
            yield "short", words[i], w, 1.0 / len(missing)


_VOTES = "kind string, what string, meaning string, votes double"


def learn(values: DataFrame, references: list[str], share: float = SHARE) -> Learnt:
    """Decoration and abbreviations that at least ``share`` of the distinct values shows.

    What comes to the driver is bounded by the share: a value has less than ten votes.
    """
    names = {tuple(sorted(r.lower().split("_"))): r for r in references}
    lexicon = {w for ws in names for w in ws}
    by_rest: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for ws in names:
        for w in set(ws):
            rest = list(ws)
            rest.remove(w)
            by_rest[tuple(rest)].append(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: Counter = Counter()
        for batch in batches:
            for value in batch.column("value").to_pylist():
                for kind, what, meaning, n in explain(typed_words(value), names, by_rest):
                    if kind != "short" or what not in lexicon:
                        votes[kind, what, meaning] += n
        cols = list(zip(*votes)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(votes.values()), pa.float64())], names=["kind", "what", "meaning", "votes"])

    return _learnt(values.select("value").mapInArrow(run, _VOTES), max(LEAST_VOTES, share * values.count()), lexicon)


def learn_joined(values: DataFrame, references: DataFrame, lexicon: set[str], share: float = SHARE) -> Learnt:
    """The same for a long reference list: what a value's words leave over is found by joins on sorted words."""
    key = lambda ws: F.array_join(F.array_sort(ws), "_")
    names = references.select(F.split(F.lower("canonical_name"), "_").alias("ws")).select(key(F.col("ws")).alias("key"), F.array_sort("ws").alias("ws")).dropDuplicates(["key"])
    spots = names.select("ws", F.posexplode("ws").alias("k", "meaning"))
    rest = F.filter(F.col("ws"), lambda x, i: i != F.col("k"))
    rests = spots.select(F.array_join(rest, "_").alias("key"), "meaning").distinct()
    rests = rests.join(rests.groupBy("key").agg(F.count("*").alias("missing")), "key")

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for value in batch.column("value").to_pylist():
                words = typed_words(value)
                n = len(words)
                spans = [(i, j) for i in range(min(4, n)) for j in range(n, max(i, n - 3), -1) if i or j < n]
                rows.extend((value, "_".join(sorted(words[i:j])), place, " ".join(words[:i]), " ".join(words[j:]), None) for place, (i, j) in enumerate(spans))
                rows.extend((value, "_".join(sorted(words[:i] + words[i + 1 :])), -1, None, None, words[i]) for i in range(n) if n > 1)
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["value", "key", "place", "head", "tail", "word"])

    cut = scratch.table(values.select("value").mapInArrow(cuts, "value string, key string, place int, head string, tail string, word string"), "cuts")
    whole = cut.where("place >= 0").join(names.select("key"), "key", "left_semi").groupBy("value").agg(F.min(F.struct("place", "head", "tail")).alias("b"))
    whole = scratch.table(whole.select("value", "b.head", "b.tail"), "decorated")
    one = lambda kind: whole.where(F.col(kind) != "").select(F.lit(kind).alias("kind"), F.col(kind).alias("what"), F.lit("").alias("meaning"), F.lit(1.0).alias("votes"))
    short = cut.where("place < 0").join(whole.select("value"), "value", "left_anti").join(rests, "key")
    known = references.select(F.explode(F.split(F.lower("canonical_name"), "_")).alias("word")).distinct()
    short = short.join(known, "word", "left_anti").select(F.lit("short").alias("kind"), F.col("word").alias("what"), "meaning", (1.0 / F.col("missing")).alias("votes"))
    return _learnt(one("head").unionByName(one("tail")).unionByName(short), max(LEAST_VOTES, share * values.count()), lexicon)


def _learnt(votes: DataFrame, least: float, lexicon: set[str]) -> Learnt:
    rows = votes.groupBy("kind", "what", "meaning").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= least).collect()
    sums: Counter = Counter()
    for r in rows:
        if r.kind == "short":
            sums[r.what] += r.votes
    short: dict[str, list[str]] = defaultdict(list)
    for r in sorted(rows):
        if r.kind == "short" and r.votes >= 0.3 * sums[r.what] and r.what[0].isalpha():
            short[r.what].append(r.meaning)
    # letters in order tell the word, where they are in one of those that the votes leave
    short = {a: [w for w in ws if in_order(a, w)] or ws for a, ws in short.items()}
    affixes = {kind: frozenset(tuple(r.what.split(" ")) for r in rows if r.kind == kind and not all(w in lexicon for w in r.what.split(" "))) for kind in ("head", "tail")}
    return Learnt(affixes["head"], affixes["tail"], {k: tuple(v) for k, v in short.items()})


def grams(words) -> Counter:
    """Weighted character n-grams of padded words, so that the order of the words does not matter.

    A word of confidence c counts c, and what was typed counts the rest.
    """
    out: Counter = Counter()
    for word, sure, typed in words:
        for w, c in ((word, sure), (typed, 1 - sure)):
            if c > 0:
                padded = f" {w} "
                for i in range(max(1, len(padded) - GRAM + 1)):
                    out[padded[i : i + GRAM]] += c
    return out


def reference_words(name: str) -> list[tuple[str, float, str]]:
    """The words of a reference as they are."""
    return [(w, 1.0, w) for w in name.lower().split("_") if w]


def norm_of(bag: Counter, idf: dict[str, float], rare: float) -> float:
    """The length of a bag of grams with inverse-frequency weights."""
    return math.sqrt(sum((n * idf.get(g, rare)) ** 2 for g, n in bag.items())) or 1.0


class Typed:
    """A typed name's parts as weighted bags of grams, one for each word that a part may be."""

    def __init__(self, tokens: list[list[tuple[str, float, str]]], idf: dict[str, float], rare: float):
        self.idf, self.rare, self.norms = idf, rare, {}
        self.bags = [[grams([c]) for c in choices] for choices in tokens]
        # the length of any combination is at least this
        self.shortest = math.sqrt(sum(min(norm_of(b, idf, rare) ** 2 for b in bags) for bags in self.bags)) if self.bags else 1.0

    def norm(self, chosen: tuple[int, ...]) -> float:
        """The length of one combination."""
        if chosen not in self.norms:
            whole: Counter = Counter()
            for bags, c in zip(self.bags, chosen):
                whole.update(bags[c])
            self.norms[chosen] = norm_of(whole, self.idf, self.rare)
        return self.norms[chosen]

    def score(self, weights: dict[str, float]) -> float:
        """The cosine with a reference of unit length, in the words that suit it best."""
        chosen, total = [], 0.0
        for bags in self.bags:
            dots = [sum(n * self.idf.get(g, self.rare) * weights[g] for g, n in b.items() if g in weights) for b in bags]
            chosen.append(dots.index(max(dots)))
            total += max(dots)
        return total / self.norm(tuple(chosen))


class Index:
    """Inverted index of a reference list with inverse-frequency weights."""

    def __init__(self, references: list[tuple[int, str]], learnt: Learnt = Learnt(), least: float = THRESHOLD - MARGIN):  # noqa: B008 - frozen
        self.ids, self.least = np.array([i for i, _ in references], np.int64), least
        self.normaliser = Normaliser({w for _, r in references for w in r.lower().split("_")}, learnt)
        bags = [grams(reference_words(name)) for _, name in references]
        df: Counter = Counter(g for b in bags for g in b)
        self.idf = {g: 1 + math.log(len(bags) / n) for g, n in df.items()}
        self.rare = 1 + math.log(len(bags) or 1)
        postings: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for k, b in enumerate(bags):
            norm = norm_of(b, self.idf, self.rare)
            for g, n in b.items():
                postings[g][0].append(k)
                postings[g][1].append(n * self.idf[g] / norm)
        self.postings = {g: (np.array(a), np.array(w)) for g, (a, w) in postings.items()}

    def best(self, value: str) -> tuple[int, float, float]:
        """(ref_id, score, runner-up's score) of the best reference."""
        typed = Typed(self.normaliser.tokens(value), self.idf, self.rare)
        dots, chosen = np.zeros(len(self.ids)), []
        for bags in typed.bags:
            each = np.zeros((len(bags), len(self.ids)))
            for c, bag in enumerate(bags):
                for g, n in bag.items():
                    hit = self.postings.get(g)
                    if hit:
                        each[c, hit[0]] += hit[1] * (n * self.idf[g])
            chosen.append(each.argmax(axis=0))
            dots += each.max(axis=0)
        bound = dots / typed.shortest
        bound[bound < self.least - 1e-9] = 0
        lead, second, ref = 0.0, 0.0, -1
        order = np.argsort(-bound, kind="stable")
        for k in order[: np.count_nonzero(bound)].tolist():
            if bound[k] < second - 1e-12:
                break
            score = float(dots[k] / typed.norm(tuple(int(c[k]) for c in chosen)))
            if score < self.least:
                continue
            if score > lead or score == lead and ref >= 0 and self.ids[k] < ref:
                lead, second, ref = score, lead, int(self.ids[k])
            else:
                second = max(second, score)
        return ref, lead, second


MATCH = "value string, ref_id bigint, score double, runner_up double"


def accepted(scored: DataFrame, threshold: float, margin: float) -> DataFrame:
    """``ref_id`` -1 where the best score misses the threshold or the margin."""
    sure = (F.col("score") >= threshold) & (F.col("score") - F.col("runner_up") >= margin)
    return scored.withColumn("ref_id", F.when(sure, F.col("ref_id")).otherwise(F.lit(-1).cast("bigint")))


def match_names(values: DataFrame, references: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, in_task: int = IN_TASK, share: float = SHARE) -> DataFrame:
    """``MATCH`` of every distinct ``value``; ``references(ref_id bigint, canonical_name)``."""
    distinct = scratch.table(values.select("value").where("value is not null and value <> ''").distinct(), "values")
    listed = references.select("ref_id", "canonical_name").where("ref_id is not null and canonical_name is not null")
    head = listed.limit(in_task + 1).collect()  # the check of the size that the index may have in a task
    if len(head) > in_task:
        return accepted(_joined(distinct, listed, threshold - margin, share), threshold, margin)
    refs = sorted((r[0], r[1]) for r in head)
    learnt = learn(distinct, [r for _, r in refs], share) if refs else Learnt()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(refs, learnt, threshold - margin)
        for batch in batches:
            column = batch.column("value").to_pylist()
            found = [index.best(v) for v in column]
            cols = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], names=["value", "ref_id", "score", "runner_up"])

    return accepted(distinct.mapInArrow(run, MATCH), threshold, margin)


def _joined(values: DataFrame, references: DataFrame, least: float, share: float = SHARE) -> DataFrame:
    """The same scores for a long reference list: its gram index is a table, joined by the rarest grams of each value.

    The lexicon of single words (not of names) is what the tasks get; its size is checked.
    """
    lexicon = references.select(F.explode(F.split(F.lower("canonical_name"), "_")).alias("w")).where("w <> ''").distinct()
    words = {r[0] for r in lexicon.limit(LEXICON + 1).collect()}
    if len(words) > LEXICON:
        raise ValueError(f"the reference list has more than {LEXICON} different words")
    total = references.count()
    rare = 1 + math.log(total or 1)
    learnt = learn_joined(values, references, words, share) if total else Learnt()

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, g, n) for key, text in zip(batch.column("ref_id").to_pylist(), batch.column("canonical_name").to_pylist()) for g, n in grams(reference_words(text)).items()]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.float64()))], names=["ref_id", "gram", "n"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normaliser = Normaliser(words, learnt)
        for batch in batches:
            rows = [(v, p, c, g, n) for v in batch.column("value").to_pylist() for p, choices in enumerate(normaliser.tokens(v)) for c, choice in enumerate(choices) for g, n in grams([choice]).items()]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()))], names=["value", "part", "choice", "gram", "n"])

    def rebuilt(bag: list[dict]) -> tuple[Typed, dict[str, float]]:
        typed, idf = Typed([], {b["gram"]: b["idf"] for b in bag}, rare), {b["gram"]: b["idf"] for b in bag}
        slots: dict[int, dict[int, Counter]] = defaultdict(lambda: defaultdict(Counter))
        for b in bag:
            slots[b["part"]][b["choice"]][b["gram"]] = b["n"]
        typed.bags = [[slots[p][c] for c in sorted(slots[p])] for p in sorted(slots)]
        typed.shortest = math.sqrt(sum(min(norm_of(b, idf, rare) ** 2 for b in x) for x in typed.bags)) or 1.0
        return typed, idf

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rarest grams of each value; what the others can add to a score stays below ``least``."""
        for batch in batches:
            rows = []
            for value, bag in zip(batch.column("value").to_pylist(), batch.column("bag").to_pylist()):
                typed, idf = rebuilt(bag)
                most: Counter = Counter()  # per gram, what the choices that have the most of it give it
                for choices in typed.bags:
                    for g in {g for b in choices for g in b}:
                        most[g] += max(b[g] for b in choices) * idf[g]
                order = sorted(most, key=lambda g: (-idf[g], g))
                rest = sum(w * w for w in most.values())
                for g in order:
                    if math.sqrt(max(rest, 0.0)) < least * typed.shortest - 1e-9:
                        break
                    rows.append((value, g))
                    rest -= most[g] ** 2
            cols = list(zip(*rows)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["value", "gram"])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bag, weights in zip(batch.column("bag").to_pylist(), batch.column("weights").to_pylist()):
                out.append(rebuilt(bag)[0].score({w["gram"]: w["w"] for w in weights}))
            yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("ref_id"), pa.array(out, pa.float64())], names=["value", "ref_id", "score"])

    index = scratch.table(references.mapInArrow(bags, "ref_id bigint, gram string, n double"), "grams")
    idf = scratch.table(index.groupBy("gram").agg((F.lit(1.0) + F.log(F.lit(float(total)) / F.count("*"))).alias("idf")), "idf")
    index = index.join(idf, "gram").withColumn("w", F.col("n") * F.col("idf"))
    length = F.sqrt(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    weighted = index.groupBy("ref_id").agg(F.collect_list(F.struct("gram", "w")).alias("weights"))
    weighted = scratch.table(weighted.withColumn("length", length).select("ref_id", F.transform("weights", lambda x: F.struct(x["gram"].alias("gram"), (x["w"] / F.col("length")).alias("w"))).alias("weights")), "weighted")
    typed = values.mapInArrow(parts, "value string, part int, choice int, gram string, n double").join(idf, "gram", "left")
    typed = typed.withColumn("idf", F.coalesce("idf", F.lit(rare)))
    typed = scratch.table(typed.groupBy("value").agg(F.collect_list(F.struct("part", "choice", "gram", "n", "idf")).alias("bag")), "typed")
    probed = typed.mapInArrow(probes, "value string, gram string")
    pairs = probed.join(index.select("gram", "ref_id"), "gram").select("value", "ref_id").distinct()
    scored = pairs.join(typed, "value").join(weighted, "ref_id").select("value", "ref_id", "bag", "weights").mapInArrow(scores, "value string, ref_id bigint, score double").where(F.col("score") >= least)
    w = Window.partitionBy("value").orderBy(F.desc("score"), "ref_id")
    two = scored.withColumn("runner_up", F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("k", F.row_number().over(w)).where("k = 1")
    out = values.join(two, "value", "left")
    return out.select("value", F.coalesce("ref_id", F.lit(-1).cast("bigint")).alias("ref_id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("runner_up", F.lit(0.0)).alias("runner_up"))
