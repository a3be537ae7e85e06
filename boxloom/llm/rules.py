"""Quality rules: statistics of texts and a decision list learned over them.

Statistics and verdicts are built-in column functions over whole texts. The list is
learned by sequential covering: a rule grows by the threshold condition with the best
information gain on one part of the labelled rows, is pruned on the other part, and the
rows it covers leave before the next rule grows, until a rule fails on the other part.
Every boundary between two values of a statistic is a candidate threshold. What is
learned is a list of ``Rule`` objects, and :func:`verdict` turns it into one ordered
conditional expression.

Learning reads at most ``FIT_ROWS`` labelled rows (those whose id hashes lowest) and
their statistics, a few numbers each; judging reads every document.

Defined cases: a null text has no words; ids without label or labels without quality
do not teach; repeated labels of an id teach once each; with no labels of both kinds the
list is empty and only the base rules judge; no documents give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.tables import narrow

#: Labelled rows the list is learned from, at most.
FIT_ROWS = 12_000
#: Conditions in a rule.
MOST_CONDITIONS = 4
#: A rule stays only if so large a share of the rows it rejects is of low quality.
LEAST_PRECISION = 0.9
#: Rows of low quality a rule has to cover.
LEAST_COVER = 8
#: No stop of its own: more rules than this cannot each cover rows of their own.
MOST_RULES = FIT_ROWS // LEAST_COVER

#: Statistics that rules may test, as expressions over the counts.
FEATURES: dict[str, str] = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] >= self.bound if self.above else row[self.feature] < self.bound

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.bound) if self.above else value < F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def _bound_once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated_words(words: Column) -> Column:
    """Words in three-word windows that stand twice or more in the text.

    Only texts whose windows are not all different sort them: equal windows are then
    neighbours, and the places they start at give the covered words.
    """

    def windows(w: Column) -> Column:
        n = F.size(w) - 2
        triples = F.arrays_zip(F.slice(w, 1, n).alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"))
        return F.transform(triples, lambda t: F.concat_ws(" ", t["a"], t["b"], t["c"]))

    def covered(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k, j: F.get(s, j)["x"] == F.get(s, k)["x"]
            kept = F.filter(s, lambda x, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda i, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - i), F.lit(3)))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return _bound_once(_bound_once(placed, places), total)

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("bigint")).otherwise(covered(found))

    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(_bound_once(windows(words), count))


def statistics(docs: DataFrame) -> DataFrame:
    """Counts and :data:`FEATURES` of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = narrow(docs, doc_id="doc_id", text=text).select(
        "doc_id", "text",
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    left = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("bigint")
    counted = split.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
        left(r"[^\p{Lu}]+").alias("n_upper"),
        left("[^!|]+").alias("n_marks"),
    )
    return counted.select("*", *[F.expr(e).cast("double").alias(f"f_{name}") for name, e in FEATURES.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Information gained on the covered bad rows by narrowing a rule."""
    if not bad:
        return 0.0
    return bad * (log2(bad / (bad + good)) - log2(bad_before / (bad_before + good_before)))


def _split(rows: list[tuple[dict, bool]]) -> tuple[int, int]:
    bad = sum(1 for _, b in rows if b)
    return bad, len(rows) - bad


def _best(rows: list[tuple[dict, bool]]) -> tuple[Condition, float] | None:
    """The condition with the highest gain on the rows."""
    total_bad, total_good = _split(rows)
    best = None
    for name in FEATURES:
        ordered = sorted((row[name], bad) for row, bad in rows)
        below_bad = below = 0
        for k in range(1, len(ordered)):
            below += 1
            below_bad += ordered[k - 1][1]
            low, high = ordered[k - 1][0], ordered[k][0]
            if high == low:
                continue
            bound = (low + high) / 2
            bound = bound if bound > low else high  # neighbours with no number between them
            for above, bad, n in ((False, below_bad, below), (True, total_bad - below_bad, len(ordered) - below)):
                gain = _gain(bad, n - bad, total_bad, total_good)
                if best is None or gain > best[1]:
                    best = (Condition(name, above, bound), gain)
    return best


def _covered(rule: Rule, rows: list[tuple[dict, bool]]) -> list[tuple[dict, bool]]:
    return [r for r in rows if all(c.holds(r[0]) for c in rule)]


def _worth(rule: Rule, rows: list[tuple[dict, bool]]) -> float:
    bad, good = _split(_covered(rule, rows))
    return (bad - good) / (bad + good) if bad + good else -1.0


def learn(rows: list[tuple[dict[str, float], bool]]) -> list[Rule]:
    """An ordered list of rejecting rules from ``(features, is low quality)`` rows."""
    growing, pruning = rows[0::3] + rows[1::3], rows[2::3]
    rules: list[Rule] = []
    while True:
        bad, good = _split(growing)
        if bad < LEAST_COVER or not good:
            break
        rule: Rule = ()
        reached = growing
        while len(rule) < MOST_CONDITIONS and _split(reached)[1]:
            found = _best(reached)
            if found is None or found[1] <= 0:
                break
            rule += (found[0],)
            reached = _covered(rule, reached)
        while len(rule) > 1 and _worth(rule[:-1], pruning) >= _worth(rule, pruning):
            rule = rule[:-1]
        bad, good = _split(_covered(rule, growing) + _covered(rule, pruning))
        if not rule or bad < LEAST_COVER or bad < LEAST_PRECISION * (bad + good):
            break
        rules.append(rule)
        growing = [r for r in growing if not all(c.holds(r[0]) for c in rule)]
        pruning = [r for r in pruning if not all(c.holds(r[0]) for c in rule)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from labelled documents; ``labels`` has doc_id and quality (0 or 1)."""
    taught = narrow(labels, doc_id="doc_id", quality="quality").filter("doc_id is not null and quality is not null")
    chosen = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)
    known = docs.filter("doc_id is not null").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    # filtered and sorted here: a filter or sort in the query would take the statistics
    # of all documents, or take them twice
    found = statistics(known).join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "quality", base_failed().alias("failed"), *[F.col(f"f_{name}").alias(name) for name in FEATURES]
    ).collect()
    rows = sorted((r.asDict() for r in found if not r["failed"]), key=lambda r: (r["doc_id"] * 2654435761 % (1 << 32), *r.values()))
    return learn([({name: r[name] for name in FEATURES}, r["quality"] == 0) for r in rows])


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression: the number of the first rule that rejects, or null."""
    out = None
    for number, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for condition in rule:
            holds &= Condition(f"f_{condition.feature}", condition.above, condition.bound).column()
        out = F.when(holds, F.lit(number)) if out is None else out.when(holds, F.lit(number))
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, ``base_failed``, the rejecting ``rule`` and ``kept`` of every document."""
    rules = fit(docs, labels)
    return statistics(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules).isNull()).alias("kept"),
        verdict(rules).alias("rule"),
    )
