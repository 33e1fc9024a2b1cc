"""Quality rules: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._store import let, stored
from vellum.llm.line_dedup import STRIP

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: name -> (value, kind, a vote against beyond this, a vote for within this); between them the rule abstains.
#: Values are ratios of the counts below; "low" rules are against small values, "high" rules against large ones.
#: Length is a base rule: as a vote it would make short texts the class that the model calls bad.
RULES = {
    "repeats": ("repeat_share", "high", 0.5, 0.2),
    "symbols": ("symbols_per_word", "high", 0.05, 0.01),
    "dup_lines": ("dup_line_share", "high", 0.3, 0.05),
    "long_words": ("chars_per_word", "high", 12.0, 9.0),
    "short_words": ("chars_per_word", "low", 2.5, 3.5),
    "capitals": ("upper_share", "high", 0.3, 0.15),
    "marks": ("marks_per_word", "high", 0.1, 0.02),
}
#: Start of the fit: share of good texts; chances of the votes -1, 0, 1 on a good text and on a bad one.
GOOD_SHARE, ON_GOOD, ON_BAD = 0.85, (0.02, 0.08, 0.90), (0.30, 0.20, 0.50)
#: Bounds of the chance of a vote against: rules seldom fire on good texts, and each tells something of bad ones.
#: Without them the fit can call one frequent fault "bad" and all others good (figures in the README).
AGAINST_GOOD, AGAINST_BAD = (0.0001, 0.004), (0.05, 0.9)
#: The start counts like so many rows, so no chance becomes 0. The share stays within the range.
ITERATIONS, PRIOR_ROWS, SHARE_RANGE = 30, 10.0, (0.05, 0.95)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(w: Column) -> Column:
    """Words in windows of 3 that the text has twice or more. Windows are compared by 64 bits of hash, within the text."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def spread(s: Column) -> Column:  # s: (hash, position), sorted
        hit = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        at = lambda d: F.transform(hit, lambda x: x["i"] + d)
        return F.size(F.array_distinct(F.concat(at(0), at(1), at(2))))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, spread))

    return F.when(F.size(w) < 4, 0).otherwise(let(hashes, count))


def measures(text: Column) -> Column:
    """All counts of one text as a struct; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    body = F.btrim(text, F.lit(STRIP))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[ \t-\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(STRIP)) != "")
    without = lambda cls: (F.octet_length(text) - F.octet_length(F.regexp_replace(text, cls, ""))).cast("bigint")
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return let(
        F.struct(words.alias("w"), of_lines.alias("l")),
        lambda s: F.struct(
            F.size(s["w"]).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(s["w"], "")).cast("bigint").alias("word_chars"),
            without(r"[#*$%&|<>]").alias("n_symbols"),
            s["l"]["dup"].cast("bigint").alias("n_dup_lines"),
            _repeated(s["w"]).cast("bigint").alias("n_repeat_words"),
            s["l"]["all"].cast("bigint").alias("n_lines"),
            without("[A-Z]").alias("n_upper"),
            without("!").alias("n_marks"),
        ),
    )


def votes(m: Column) -> list[Column]:
    """-1, 0 or 1 for each of RULES; all abstain on a text without words."""
    words, chars, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["word_chars"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
    value = {
        "repeat_share": m["n_repeat_words"] / words,
        "symbols_per_word": m["n_symbols"] / words,
        "dup_line_share": m["n_dup_lines"] / lines,
        "chars_per_word": m["word_chars"] / words,
        "upper_share": m["n_upper"] / chars,
        "marks_per_word": m["n_marks"] / words,
    }
    out = []
    for of, side, bad, good in RULES.values():
        v = value[of]
        vote = F.when(v < bad, -1).when(v >= good, 1) if side == "low" else F.when(v > bad, -1).when(v <= good, 1)
        out.append(F.when(m["n_words"] == 0, 0).otherwise(vote.otherwise(0)))
    return out


def _posterior(v: Column, state: Column) -> Column:
    """Probability that a text with votes `v` is good; votes are independent given that it is good or bad."""
    terms = F.zip_with(v, state["a"], lambda x, a: F.log(F.get(a, x + 1) / F.get(a, x + 4)))
    score = F.aggregate(terms, F.log(state["pi"] / (1 - state["pi"])), lambda s, x: s + x)
    return 1 / (1 + F.exp(-score))


def _bounded(chances: Column, within: tuple[float, float]) -> Column:
    """Chances of the votes -1, 0, 1 with the first held within bounds and the others sharing the rest as before."""
    first = F.least(F.lit(within[1]), F.greatest(F.lit(within[0]), chances[0]))
    rest = lambda k: chances[k] * (1 - first) / (chances[1] + chances[2])
    return F.array(first, rest(1), rest(2))


def _fitted(patterns: Column) -> Column:
    """struct(pi, a) from array<struct(v, n)> by expectation-maximisation, in one expression on one row.

    a has for each rule the chances of its votes -1, 0, 1 on good texts, then on bad ones: its accuracies.
    """
    start = F.struct(F.lit(GOOD_SHARE).alias("pi"), F.array(*[F.array(*map(F.lit, ON_GOOD + ON_BAD))] * len(RULES)).alias("a"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, _: Column) -> Column:
        scored = F.transform(patterns, lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), (p["n"] * _posterior(p["v"], state)).alias("g")))

        def again(s: Column) -> Column:
            good, rows = total(F.transform(s, lambda p: p["g"])), total(F.transform(s, lambda p: p["n"]))
            pi = (good + PRIOR_ROWS * GOOD_SHARE) / (rows + PRIOR_ROWS)

            def chances(j: int) -> Column:
                cast = lambda of, k: total(F.transform(s, lambda p: F.when(p["v"][j] == k, of(p)).otherwise(0.0)))
                on_good = [(cast(lambda p: p["g"], k) + PRIOR_ROWS * ON_GOOD[k + 1]) / (good + PRIOR_ROWS) for k in (-1, 0, 1)]
                on_bad = [(cast(lambda p: p["n"] - p["g"], k) + PRIOR_ROWS * ON_BAD[k + 1]) / (rows - good + PRIOR_ROWS) for k in (-1, 0, 1)]
                return F.concat(let(F.array(*on_good), lambda c: _bounded(c, AGAINST_GOOD)), let(F.array(*on_bad), lambda c: _bounded(c, AGAINST_BAD)))

            held = F.least(F.lit(SHARE_RANGE[1]), F.greatest(F.lit(SHARE_RANGE[0]), pi))
            return F.struct(held.alias("pi"), F.array(*[chances(j) for j in range(len(RULES))]).alias("a"))

        return let(scored, again)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), start, step)


def measured(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (struct of the columns of `carry`, of all by default), m (`measures`), code (the vote pattern as a number)."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row")
    m = docs.select(row, measures(F.col(f"`{text_col}`")).alias("m"))
    code = sum(((v + 1) * 3**j for j, v in enumerate(votes(F.col("m")))), F.lit(0))
    return m.withColumn("code", code.cast("int"))


def _base_failed() -> Column:
    return (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))


def label_model(counts: DataFrame) -> DataFrame:
    """One row for each vote pattern in `counts` (rows of `measured`; 3**rules patterns at most): code, posterior and the fitted parameters.

    Patterns are counted in every task before the shuffle; a row of counts is all that the model is
    fitted on. It counts every document that the base rules let pass: those that they reject would
    otherwise be the class that the fit finds.
    """
    seen = counts.groupBy("code").agg(F.sum(F.when(_base_failed(), 0.0).otherwise(1.0)).alias("n"))
    vote = lambda j: (F.floor(F.col("code") / 3**j) % 3 - 1).cast("int")
    one = seen.agg(
        F.array_sort(F.collect_list(F.struct("code", F.array(*[vote(j) for j in range(len(RULES))]).alias("v"), "n"))).alias("ps")
    ).withColumn("fit", _fitted(F.col("ps")))
    return one.select(F.explode("ps").alias("p"), "fit").select(
        "p.code", _posterior(F.col("p.v"), F.col("fit")).alias("posterior"), F.col("fit.pi").alias("good_share"), F.col("fit.a").alias("accuracies")
    )


def quality_rules(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of `carry` (all of `docs` by default) with the base counts, base_failed, posterior and kept.

    Each rule of RULES votes for a text, against it, or abstains. The model has the share of good texts
    and each rule's accuracies (chances of its votes on good and on bad texts), fitted by
    expectation-maximisation over the counts of vote patterns of all rows. kept: the base rules hold and the posterior is `threshold` or more.

    Null and empty texts have no words: they fail the base rules. Rows that repeat count as often as
    they are there. An empty table gives an empty table. Columns of `docs` with the names of the new
    ones are replaced; any other names may be there.

    Plan: one scan counts, and writes the counts beside the carried columns into the shared folder; one
    shuffle of vote patterns; one scan of what was written. The patterns joined to it are broadcast: their
    number is bounded by 3**rules (2,187).
    """
    made = (*COUNTS, "base_failed", "posterior", "kept")
    own = [c for c in (docs.columns if carry is None else carry) if c not in made]
    counts = stored(measured(docs, text_col, own), "measures")
    model = F.broadcast(label_model(counts).select("code", "posterior"))
    failed = _base_failed()
    kept = F.when(failed, False).otherwise(F.col("posterior") >= threshold)
    return counts.join(model, "code").select(
        *[F.col(f"row.`{c}`") for c in own], *[F.col(f"m.{c}").alias(c) for c in COUNTS], failed.alias("base_failed"), "posterior", kept.alias("kept")
    )
