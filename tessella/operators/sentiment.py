"""Lexicon and pattern sentiment as one map-only projection per text.

A lexicon is a list or a (word, weight) table. All its words, the negations and the
degree words become one automaton (see functions.automaton), which reads a text once
whatever their number; scores come out of the hits of that pass. Nothing is shuffled: a
text's hits live and end in its own row. A table too large for every task to hold is
joined on the grams of the texts instead (`lexicon_matches`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.data import sentiment as sd
from tessella.functions import automaton as au
from tessella.functions import text as tx
from tessella.functions.rows import bind, unnest
from tessella.operators.grams import gram_join

Lexicon = list[tuple[str, float]]
HELD_WORDS = 500_000
"""Words up to which a lexicon is held by every task."""


def _table(lexicon: Lexicon) -> Column:
    """A literal array<struct<word, weight>>."""
    if not lexicon:
        return F.expr("cast(array() as array<struct<word:string,weight:double>>)")

    def text(w: str) -> str:
        return "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("array(" + ", ".join(
        f"struct({text(w)} AS word, {float(v)!r}D AS weight)" for w, v in lexicon) + ")")


def _first_found(prefix: Column, table: Lexicon) -> Column:
    found = F.filter(_table(table), lambda w: F.contains(prefix, w["word"]))
    return F.coalesce(F.get(found, 0)["weight"], F.lit(1.0))


def by_length(table: Lexicon) -> Lexicon:
    return sorted(table, key=lambda r: -len(r[0]))


def negation(prefix: Column, table=sd.NEGATIONS) -> Column:
    """Factor of the first negation, in table order, found before a hit."""
    return _first_found(prefix, table)


def intensity(prefix: Column, table=sd.INTENSIFIERS) -> Column:
    """Factor of the longest degree word before a hit; the earlier one on ties."""
    return _first_found(prefix, by_length(table))


def _lower(lexicon: Lexicon) -> Lexicon:
    return [(w.lower(), v) for w, v in lexicon]


def held(lexicon: DataFrame | Lexicon | None) -> Lexicon:
    """The words and weights, of a table once its rows are counted to be few enough."""
    if lexicon is None:
        return sd.LEXICON
    if isinstance(lexicon, DataFrame):
        rows = lexicon.where("word <> '' AND weight IS NOT NULL").select("word", F.col("weight").cast("double")).limit(HELD_WORDS + 1).collect()
        if len(rows) > HELD_WORDS:
            raise ValueError(f"scores need a lexicon of at most {HELD_WORDS} words; lexicon_matches takes any")
        return [tuple(r) for r in rows]
    return [(w, v) for w, v in lexicon if w]


class Words:
    """The automaton of several tables, with what each word means in each of them."""

    def __init__(self, **tables: Lexicon):
        self.automaton = au.Automaton(w for table in tables.values() for w, _ in table)
        place = {w: k for k, w in enumerate(self.automaton.words)}
        n = len(place)
        self.many, self.total, self.rank, self.factor = {}, {}, {}, {}
        for name, table in tables.items():
            self.many[name], self.total[name] = np.zeros(n, np.int64), np.zeros(n)
            self.rank[name], self.factor[name] = np.full(n, len(table)), np.array([*[v for _, v in table], 1.0], np.float64)
            for r, (w, v) in enumerate(table):
                k = place[w]
                self.many[name][k] += 1
                self.total[name][k] += v
                self.rank[name][k] = min(self.rank[name][k], r)

    def factors(self, table: str, start: np.ndarray, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For every stretch [low, high) the factor of the first word of the table, in its
        order, that lies inside; start and word: all occurrences, by start."""
        own = self.many[table][word] > 0
        at, kind = start[own], word[own]
        a, b = np.searchsorted(at, low), np.searchsorted(at, high)
        n = np.maximum(b - a, 0)
        of = np.repeat(np.arange(len(low)), n)
        one = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[of]
        inside = at[one] + self.automaton.length[kind[one]] <= high[of]
        best = np.full(len(low), len(self.factor[table]) - 1)
        np.minimum.at(best, of[inside], self.rank[table][kind[one[inside]]])
        return self.factor[table][best]


class Scores:
    """Lexicon and sentence score of texts in one language; both from one pass."""

    def __init__(self, lexicon: Lexicon, negated: Lexicon, window: int, sentence_context: bool):
        self.words = Words(lexicon=lexicon, negated=negated, negation=sd.NEGATIONS, degree=by_length(sd.INTENSIFIERS))
        self.window, self.sentence_context = window, sentence_context
        self.ends = np.array(sorted(map(ord, sd.SENTENCE_ENDS)), np.uint32)

    def weighted(self, hits: tuple[np.ndarray, np.ndarray], start: np.ndarray, floor: np.ndarray) -> np.ndarray:
        low = np.maximum(start - self.window, floor)
        return self.words.factors("negation", *hits, low, start) * self.words.factors("degree", *hits, low, start)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, begins = au.characters(texts)
        hits = start, word = self.words.automaton.find(codes)
        text = np.searchsorted(begins, start, side="right") - 1
        n, length = len(texts), self.words.automaton.length
        own = self.words.many["lexicon"][word] > 0
        told = self.words.many["negated"][word] > 0
        free = au.apart(text, start, word, length)

        s, w, t = (x[own & free] for x in (start, word, text))
        value = self.words.total["lexicon"][w] * self.weighted(hits, s, begins[t])
        total = np.bincount(t, value, n) + np.bincount(text[told & free], self.words.total["negated"][word[told & free]], n)
        count = (np.bincount(t, self.words.many["lexicon"][w], n)
                 + np.bincount(text[told & free], self.words.many["negated"][word[told & free]], n))
        lexicon = np.divide(total, count, out=np.zeros(n), where=count > 0)

        stop = np.isin(codes, self.ends)
        stop[begins[1:] - 1] = True
        before = np.concatenate(([0], np.cumsum(stop)))  # stops before a place
        whole = own & (before[start] == before[start + length[word]])
        s, w, t = (x[whole] for x in (start, word, text))
        sentence = before[s]
        order = np.lexsort((s, w, sentence))
        first = np.ones(len(order), bool)
        first[1:] = (sentence[order][1:] != sentence[order][:-1]) | (w[order][1:] != w[order][:-1])
        s, w, t, sentence = (x[order[first]] for x in (s, w, t, sentence))
        value = self.words.total["lexicon"][w]
        if self.sentence_context:
            last_stop = np.concatenate(([-1], np.flatnonzero(stop)))[sentence]
            value = value * self.weighted(hits, s, last_stop + 1)
        names, of = np.unique(sentence, return_inverse=True)
        mean = np.bincount(of, value, len(names)) / np.bincount(of, self.words.many["lexicon"][w], len(names))
        owner = np.zeros(len(names), np.int64)
        owner[of] = t
        many = np.bincount(owner, minlength=n)
        return lexicon, np.divide(np.bincount(owner, mean, n), many, out=np.zeros(n), where=many > 0)


def _scores(text: Column, language: Column, lexicon: DataFrame | Lexicon | None) -> Column:
    """struct<lexicon, sentence> of each text, NULL for NULL."""
    lexicon = held(lexicon)
    negated = [(n + w, -1.2 * v) for w, v in lexicon if v > 0 for n in sd.NEGATED_POSITIVE]
    chinese = Scores(lexicon, negated, sd.WINDOW["chinese"], True)
    english = Scores(_lower(lexicon), [], sd.WINDOW["english"], False)

    @F.arrow_udf("struct<lexicon:double,sentence:double>")
    def score(texts: pa.Array, is_chinese: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), 2))
        there = np.asarray(texts.is_valid())
        kind = np.asarray(is_chinese.fill_null(False))
        for which, scorer in ((there & kind, chinese), (there & ~kind, english)):
            rows = np.flatnonzero(which)
            done = 0
            for run in au.runs(texts.take(pa.array(rows))):
                at = rows[done:done + len(run)]
                out[at, 0], out[at, 1] = scorer.of(run)
                done += len(run)
        return pa.StructArray.from_arrays([pa.array(out[:, 0], mask=~there), pa.array(out[:, 1], mask=~there)], ["lexicon", "sentence"])
    chinese_text = language == "chinese"
    return score(F.when(chinese_text, text).otherwise(F.lower(text)), chinese_text)


def lexicon_score(text: Column, language: Column, lexicon=None) -> Column:
    """Mean of weight, negation and degree over all hits; in Chinese also of negated
    positive words."""
    return _scores(text, language, lexicon)["lexicon"]


def sentence_score(text: Column, language: Column, lexicon=None) -> Column:
    """Mean per sentence over the first hit of each word, then over sentences."""
    return _scores(text, language, lexicon)["sentence"]


def _hits(text: Column, lexicon: Lexicon, schema: str, build: Callable) -> Column:
    """An array per text of what build makes of (text, word's place in the automaton,
    start), for every hit that does not overlap an earlier one of its word."""
    words = au.Automaton(w for w, _ in lexicon)
    weights: dict[str, list[float]] = {}
    for w, v in lexicon:
        weights.setdefault(w, []).append(float(v))
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    kind = pa.list_(pa.struct([(n, kinds[k]) for n, k in (f.split(":") for f in schema.split(","))]))

    @F.arrow_udf(f"array<struct<{schema}>>")
    def find(texts: pa.Array) -> pa.Array:
        out = []
        for run in au.runs(texts):
            codes, begins = au.characters(run)
            start, word = words.find(codes)
            of = np.searchsorted(begins, start, side="right") - 1
            free = au.apart(of, start, word, words.length)
            found: list[list[dict]] = [[] for _ in range(len(run))]
            held_ = run.to_pylist()
            for t, w, s in zip(of[free].tolist(), word[free].tolist(), (start - begins[of])[free].tolist()):
                name = words.words[w]
                found[t] += [build(held_[t], name, v, s) for v in weights[name]]
            out.append(pa.array(found, kind))  # a run at a time: rows of Python take many times the room
        return pa.concat_arrays(out) if out else pa.array([], kind)
    return find(text)


FOLDED = "ſKıİ"
"""What matches s, k and i where case is ignored, besides these letters themselves."""


def pattern_score(text: Column, language: Column) -> Column:
    """Patterns are matched only in texts that hold the strings they need."""
    odd = F.contains(text, F.lit(FOLDED[0]))
    for c in FOLDED[1:]:
        odd = odd | F.contains(text, F.lit(c))

    def total(patterns, on: Column, flags: str, searched: Column) -> Column:
        out = F.lit(0.0)
        for p, v in patterns:
            times = F.regexp_count(on, F.lit(f"(?{flags}){p}"))
            held = tx.holds(searched, p, 32, lowered="i" in flags)
            if held is not None:
                times = F.when(on.isNull() | held | (odd if "i" in flags else F.lit(False)), times).otherwise(0)
            out = out + times * v
        return out
    # All but the last general pattern need a Chinese character or one of three
    # ASCII words, so other texts skip them after one scan.
    general, latin = sd.PATTERNS[:-1], sd.PATTERNS[-1:]
    possible = text.rlike(rf"(?i){tx.CJK}|yyds|666|lj")
    zh = F.when(possible, total(general, text, "d", text)).otherwise(0.0) + total(latin, text, "d", text)
    en = bind(F.lower(text), lambda t: F.when(possible, total(general, text, "diu", t)).otherwise(0.0)
              + total(latin, text, "diu", t) + total(sd.ENGLISH_PATTERNS, t, "d", t))
    return F.when(language == "chinese", zh).otherwise(en)


def emoji_score(text: Column, table=None) -> Column:
    score, n = F.lit(0.0), F.lit(0)
    for sign, value in (sd.EMOJI if table is None else table):
        times = (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))) / len(sign)
        score, n = score + times * value, n + times
    return F.when(n > 0, score / n).otherwise(0.0)


def sentiment(docs: DataFrame, text: str = "text", lexicon=None, emoji=None,
              model_score: str | None = None) -> DataFrame:
    """Adds the four scores, the blend, label, name and confidence. A Chinese
    model score between -1 and 1 may be given as a column."""
    t = F.col(text)
    rows = docs.withColumn("language", tx.language_by_majority(t))
    rows = rows.withColumn("_scores", _scores(t, F.col("language"), lexicon)).withColumns({
        "lexicon_score": F.col("_scores.lexicon"),
        "pattern_score": pattern_score(t, F.col("language")),
        "sentence_score": F.col("_scores.sentence"),
        "emoji_score": emoji_score(t, emoji)}).drop("_scores")

    def blend(weights: dict, model: Column | None = None) -> Column:
        out = F.lit(0.0)
        for k, v in weights.items():
            out = out + (model if k == "model" else F.col(f"{k}_score")) * v
        return out
    raw = blend(sd.BLEND)
    if model_score:
        raw = F.when((F.col("language") == "chinese") & F.col(model_score).isNotNull(),
                     blend(sd.BLEND_WITH_MODEL, F.col(model_score))).otherwise(raw)
    blank = ~F.coalesce(t.rlike(tx.NON_SPACE), F.lit(False))
    rows = rows.withColumn("raw_score", F.when(blank, 0.0).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))))
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), (F.col("raw_score") + 1) / 2))
    rows = rows.withColumn("positive_score", p)
    s = F.col("positive_score")
    return rows.withColumns({
        "negative_score": 1 - s,
        "sentiment": F.when(s >= 0.5, "positive").otherwise("negative"),
        "sentiment_name": F.when(blank, "正面").when(s >= 0.8, "非常正面").when(s >= 0.65, "比较正面")
        .when(s >= 0.5, "正面").when(s <= 0.2, "非常负面").when(s <= 0.35, "比较负面").otherwise("负面"),
        "confidence": F.when(blank, 0.5).otherwise(F.greatest(F.lit(0.5), F.least(
            F.lit(0.99), 0.5 + F.abs(s - 0.5))))})


def gauge(positive: Column) -> Column:
    """Five bands; a value on a border belongs to the lower one."""
    return (F.when(positive <= 0.2, "非常负面").when(positive <= 0.4, "比较负面")
            .when(positive <= 0.6, "中性").when(positive <= 0.8, "比较正面").otherwise("非常正面"))


def distribution(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count_if(F.col("sentiment") == "positive").alias("positive"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.avg("positive_score").alias("average_positive_score"),
        F.avg("confidence").alias("average_confidence"), F.count("*").alias("total"))


def lexicon_matches(docs: DataFrame, key: str, lexicon: DataFrame | Lexicon | None = None, text: str = "text",
                    held_words: int = HELD_WORDS) -> DataFrame:
    """(key, word, weight, position) of every hit that does not overlap an earlier one of
    its word. A table of more than `held_words` rows is joined on the grams of the texts."""
    if isinstance(lexicon, DataFrame):
        lexicon = lexicon.where("word <> '' AND weight IS NOT NULL").select("word", F.col("weight").cast("double").alias("weight"))
        if lexicon.limit(held_words + 1).count() > held_words:
            return _matches_joined(docs, key, lexicon, text)
    found = _hits(F.col(text), held(lexicon), "word:string,weight:double,position:long",
                  lambda text, word, weight, at: {"word": word, "weight": weight, "position": at})
    return unnest(docs, [key], found, "h").select(key, "h.*")


def _matches_joined(docs: DataFrame, key: str, lexicon: DataFrame, text: str) -> DataFrame:
    """Words with their grams' places, and of places that overlap those a search from left
    to right takes. Only words that can overlap themselves have such places."""
    words = lexicon.select("word").distinct()
    places = gram_join(docs, key, words, "word", text).groupBy(key, "word").agg(F.sort_array(F.collect_list("start")).alias("_at"))
    size, none = F.length("word"), F.expr("cast(array() as array<int>)")
    free = F.aggregate("_at", F.struct(none.alias("kept"), F.lit(0).alias("next")), lambda a, s: F.when(s >= a["next"], F.struct(
        F.array_append(a["kept"], s).alias("kept"), (s + size).alias("next"))).otherwise(a), lambda a: a["kept"])
    steps = F.arrays_zip(F.slice("_at", 2, F.size("_at")).alias("b"), F.slice("_at", 1, F.size("_at") - 1).alias("a"))
    near = F.exists(steps, lambda p: p["b"] - p["a"] < size)
    rows = places.select(key, "word", F.explode(F.when((F.size("_at") > 1) & near, free).otherwise(F.col("_at"))).alias("position"))
    return rows.join(lexicon, "word").select(key, "word", "weight", F.col("position").cast("long").alias("position"))


def context_factors(docs: DataFrame, key: str, lexicon=None, text: str = "text",
                    window: int = 5) -> DataFrame:
    """(key, word, before, negation, intensity), one row per hit in the lowered text."""
    found = _hits(F.lower(F.col(text)), _lower(held(lexicon)), "word:string,before:string",
                  lambda text, word, weight, at: {"word": word, "before": text[max(0, at - window):at]})
    return unnest(docs, [key], found, "h").select(
        key, "h.word", "h.before", negation(F.col("h.before")).alias("negation"),
        intensity(F.col("h.before")).alias("intensity"))
