"""Sentence fidelity: which sentences of a rewrite the original supports, and which may contradict it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fidelis.functions.text import content_words, sentences
from fidelis.rules import Term
from fidelis.rules.knee import STOP_WORDS

SHORT, PLAIN, NO_ANCHOR = "<4 content words", "no clinical content", "no premise on the same structure"


def mentions_any(text: Column, lexicon: list[Term]) -> Column:
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for t in lexicon for p in t.patterns))


def sentence_gate(rows: DataFrame, lexicon: list[Term] | None, sentence: str = "sentence", words: str = "words") -> DataFrame:
    """``rows`` with ``skip_reason``: too few content words, then no entity of the lexicon (None: any sentence counts)."""
    reason = F.when(F.size(words) < 4, SHORT)
    if lexicon is not None:
        reason = reason.when(~mentions_any(F.col(sentence), lexicon), PLAIN)
    return rows.withColumn("skip_reason", reason)


def sentence_words(df: DataFrame, text: str, *keys: str, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """``(*keys, pos, sentence, words)`` of every sentence."""
    rows = df.select(*keys, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    return rows.withColumn("words", content_words(F.col("sentence"), stop_words))


def overlap_scores(hyp: DataFrame, prem: DataFrame) -> DataFrame:
    """``(pair_id, pos, prem_pos, score)`` of sentences that share a content word with a source sentence.

    ``hyp(pair_id, original_id, pos, words)`` and ``prem(original_id, pos, words)``. Only sentences of one pair that
    share a word meet, so a word that is common everywhere is no hot key. The score is the share of the sentence's
    words.
    """
    h = hyp.select("pair_id", "original_id", "pos", F.size("words").alias("n"), F.explode("words").alias("word"))
    p = prem.select("original_id", F.col("pos").alias("prem_pos"), F.explode("words").alias("word"))
    met = h.join(p, ["original_id", "word"]).groupBy("pair_id", "pos", "prem_pos", "n").agg(F.count("*").alias("both"))
    return met.select("pair_id", "pos", "prem_pos", (F.col("both") / F.col("n")).alias("score"))


def best_premise(scores: DataFrame) -> DataFrame:
    """The best source sentence of each sentence; the first of equally good ones."""
    best = F.max(F.struct("score", (-F.col("prem_pos")).alias("back"))).alias("best")
    return scores.groupBy("pair_id", "pos").agg(best).select("pair_id", "pos", F.col("best.score").alias("score"), (-F.col("best.back")).alias("prem_pos"))


def best_matches(sentence: list[list[str] | None], source: list[list[str]]) -> list[tuple[int, int] | None]:
    """For each sentence's words the most words shared with a source sentence, and the first source sentence that has them.

    Source sentences are posted under their words. A sentence asks for its rarest words first. Once a source sentence is
    ahead of all that the words left could still add up to, lists aren't read any more: the sentences met so far are
    only asked whether they have the words left. So the long lists of common words are hardly ever read. None for None;
    (0, -1) where nothing is shared.
    """
    posts: dict[str, list[int]] = {}
    for at, words in enumerate(source):
        for w in words:
            posts.setdefault(w, []).append(at)
    sets = [set(words) for words in source]
    out: list[tuple[int, int] | None] = []
    for words in sentence:
        if words is None:
            out.append(None)
            continue
        found: dict[int, int] = {}
        order, most = sorted((w for w in words if w in posts), key=lambda w: len(posts[w])), 0
        for i, w in enumerate(order):
            if most > len(order) - i:  # nobody new can catch up, so the words left are looked up
                for at, n in found.items():
                    found[at] = n + sum(v in sets[at] for v in order[i:])
                break
            for at in posts[w]:
                found[at] = found.get(at, 0) + 1
            most = max(most, max(found[at] for at in posts[w]))
        out.append(max(((n, -at) for at, n in found.items()), default=(0, 1)))
    return [None if x is None else (x[0], -x[1]) for x in out]


def _best(sentences: pd.Series, sources: pd.Series) -> pd.Series:
    """``best_matches`` for each pair of a batch."""
    plain = lambda x: None if x is None else list(x)
    return pd.Series([[None if m is None else {"both": m[0], "prem_pos": m[1]} for m in best_matches([plain(w) for w in s], [plain(w) for w in p])] for s, p in zip(sentences, sources)])


def _matched(df: DataFrame, lexicon: list[Term] | None, stop_words: list[str], original: str, rewrite: str) -> DataFrame:
    """``df`` with ``__s``: for each sentence of the rewrite ``(skip_reason, score, prem_pos)``, all within the row."""
    words = lambda s: content_words(s, stop_words)
    whole = lambda c: sentences(F.coalesce(F.col(c), F.lit("")))
    reason = lambda h: F.when(F.size(h["w"]) < 4, SHORT) if lexicon is None else F.when(F.size(h["w"]) < 4, SHORT).when(~mentions_any(h["s"], lexicon), PLAIN)
    cut = F.transform(F.transform(whole(rewrite), lambda s: F.struct(s.alias("s"), words(s).alias("w"))), lambda h: F.struct(reason(h).alias("skip_reason"), h["w"].alias("w")))
    df = df.withColumns({"__h": cut, "__p": F.transform(whole(original), words)})
    best = F.pandas_udf(_best, "array<struct<both: int, prem_pos: int>>")
    df = df.withColumn("__m", best.asNondeterministic()(F.transform("__h", lambda h: F.when(h["skip_reason"].isNull(), h["w"])), F.col("__p")))
    score = lambda h, m: F.when(h["skip_reason"].isNotNull(), 1.0).otherwise(m["both"] / F.size(h["w"]))
    one = lambda h, m: F.struct(h["skip_reason"].alias("skip_reason"), score(h, m).alias("score"), F.when(m["both"] > 0, m["prem_pos"]).alias("prem_pos"))
    return df.withColumn("__s", F.zip_with("__h", "__m", one)).drop("__h", "__p", "__m")


def sentence_scores(pairs: DataFrame, lexicon: list[Term] | None, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """``(pair_id, original_id, pos, skip_reason, score, prem_pos)`` of every sentence of each rewrite, without texts.

    A pair's sentences are matched within its row, by ``best_matches``: no word leaves it, so nothing is shuffled, and
    the work doesn't grow with the product of both sides' sentences. Skipped sentences score 1, those that share no
    word 0; both have no ``prem_pos``. Null texts have no sentences.
    """
    rows = _matched(pairs.select("pair_id", "original_id", "original_text", "humanized_text"), lexicon, stop_words, "original_text", "humanized_text")
    return rows.select("pair_id", "original_id", F.posexplode("__s").alias("pos", "s")).select("pair_id", "original_id", "pos", "s.skip_reason", "s.score", "s.prem_pos")


def sentence_verdicts(pairs: DataFrame, lexicon: list[Term] | None, threshold: float = 0.4, stop_words: list[str] = STOP_WORDS, texts: bool = True) -> DataFrame:
    """A row for each sentence of each rewrite: skipped, or supported by a source sentence or not.

    ``pairs(pair_id, original_id, original_text, humanized_text)``. A skipped sentence counts as entailed with a score of
    1; one that shares no word has 0. The sentence and its best source sentence are fetched if ``texts`` are asked for.
    """
    scores = sentence_scores(pairs, lexicon, stop_words)
    assessed = F.col("skip_reason").isNull()
    out = scores.withColumns({"assessed": assessed, "entailed": ~assessed | (F.col("score") >= threshold)})
    if not texts:
        return out.drop("original_id")
    hyp = pairs.select("pair_id", F.posexplode(sentences(F.col("humanized_text"))).alias("pos", "sentence"))
    prem = pairs.groupBy("original_id").agg(F.first("original_text").alias("t")).select("original_id", F.posexplode(sentences(F.col("t"))).alias("prem_pos", "best_premise"))
    out = out.join(hyp, ["pair_id", "pos"]).join(prem, ["original_id", "prem_pos"], "left")
    return out.select("pair_id", "pos", "sentence", "skip_reason", "assessed", "score", F.coalesce("best_premise", F.lit("")).alias("best_premise"), "entailed")


def with_support(df: DataFrame, lexicon: list[Term] | None, threshold: float = 0.30, stop_words: list[str] = STOP_WORDS, original: str = "original_text", rewrite: str = "humanized_text") -> DataFrame:
    """``df`` with a summary of its sentences' scores and the counts of ``entailment_report``, worked out within the row.

    ``support_scores`` has the scores of the assessed sentences in ascending order, from which ``at_threshold`` reads the
    counts at any threshold.
    """
    df = _matched(df, lexicon, stop_words, original, rewrite)
    assessed = F.filter("__s", lambda x: x["skip_reason"].isNull())
    df = df.withColumns({"n_sentences": F.size("__s").cast("long"), "support_scores": F.array_sort(F.transform(assessed, lambda x: x["score"]))}).drop("__s")
    return at_threshold(df, threshold)


def score_summary(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(pair_id, n_sentences, support_scores)`` from ``sentence_scores``: the assessed sentences' scores, ascending.

    A pair without sentences has 0 and an empty array. Summaries of parts of a pair merge by ``merge_summaries``.
    """
    one = F.array_sort(F.collect_list(F.when(F.col("skip_reason").isNull(), F.col("score"))))
    found = scores.groupBy("pair_id").agg(F.count("*").alias("n_sentences"), one.alias("support_scores"))
    out = pairs.select("pair_id").distinct().join(found, "pair_id", "left")
    return out.select("pair_id", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), F.coalesce("support_scores", F.array().cast("array<double>")).alias("support_scores"))


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """One summary per pair from those of parts of it (of a rewrite's sections, say): counts add up, arrays interleave."""
    every = F.array_sort(F.flatten(F.collect_list("support_scores")))
    return summaries.groupBy("pair_id").agg(F.sum("n_sentences").alias("n_sentences"), every.alias("support_scores"))


def at_threshold(df: DataFrame, threshold: float | Column) -> DataFrame:
    """``df(support_scores)`` with ``n_assessed``, ``n_entailed``, ``n_unsupported`` and ``entailment_rate`` at a threshold.

    Nothing is measured again: the scores from ``threshold`` on are counted. The rate is 1.0 where none was assessed.
    """
    scores = F.col("support_scores")
    n, entailed = F.size(scores).cast("long"), F.size(F.filter(scores, lambda s: s >= threshold)).cast("long")
    df = df.withColumns({"n_assessed": n, "n_entailed": entailed})
    rate = F.when(F.col("n_assessed") == 0, 1.0).otherwise(F.col("n_entailed") / F.col("n_assessed"))
    return df.withColumns({"n_unsupported": F.col("n_assessed") - F.col("n_entailed"), "entailment_rate": rate})


def entailment_report(verdicts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts and the rate of assessed sentences that are entailed; 1.0 where none was assessed."""
    a, e = F.col("assessed"), F.col("entailed")
    out = verdicts.groupBy("pair_id").agg(
        F.count("*").alias("n_sentences"), F.count_if(a).alias("n_assessed"), F.count_if(a & e).alias("n_entailed"), F.count_if(a & ~e).alias("n_unsupported"))
    out = pairs.select("pair_id").distinct().join(out, "pair_id", "left").na.fill(0)
    return out.withColumn("entailment_rate", F.when(F.col("n_assessed") == 0, 1.0).otherwise(F.col("n_entailed") / F.col("n_assessed")))


def unsupported_sentences(verdicts: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` unsupported sentences of each pair."""
    rank = F.row_number().over(W.partitionBy("pair_id").orderBy("pos"))
    return verdicts.filter("assessed and not entailed").withColumn("rank", rank).filter(F.col("rank") <= k)


def contradiction_candidates(hyp: DataFrame, prem: DataFrame, anchors: list[Term] | None) -> tuple[DataFrame, DataFrame]:
    """Sentence pairs that share an anchor, and the sentences that share none.

    ``hyp(pair_id, original_id, pos, sentence)``, ``prem(original_id, pos, sentence)``; ``anchors`` None: all pairs of a pair.
    """
    from fidelis.operators.entities import canonicals

    if anchors is None:
        tag = lambda d: d.withColumn("anchor", F.lit(""))
    else:
        tag = lambda d: d.withColumn("anchor", F.explode(canonicals(F.col("sentence"), anchors)))
    p = tag(prem).select("original_id", F.col("pos").alias("prem_pos"), F.col("sentence").alias("premise"), "anchor")
    met = tag(hyp).join(p, ["original_id", "anchor"]).select("pair_id", "original_id", "pos", "sentence", "prem_pos", "premise").distinct()
    alone = hyp.join(met.select("pair_id", "pos").distinct(), ["pair_id", "pos"], "left_anti").withColumn("skip_reason", F.lit(NO_ANCHOR))
    return met, alone


def score_with(candidates: DataFrame, scores: DataFrame | Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Candidates with a model's ``contradiction``.

    ``scores`` is a table ``(pair_id, hyp_pos, prem_pos, contradiction)``, where 0 stands for what it lacks, or a scorer:
    a function of a batch of premises and one of hypotheses, which sees every different couple of sentences once. With a
    scorer the result has no texts: couples are told apart and joined by 128-bit digests.
    """
    if isinstance(scores, DataFrame):
        known = scores.select("pair_id", F.col("hyp_pos").alias("pos"), "prem_pos", "contradiction")
        return candidates.join(known, ["pair_id", "pos", "prem_pos"], "left").withColumn("contradiction", F.coalesce("contradiction", F.lit(0.0)))
    scorer = F.pandas_udf(scores, "double").asNondeterministic()
    couple = F.unhex(F.md5(F.concat(F.md5("premise"), F.md5("sentence"))))
    keyed = candidates.withColumn("__couple", couple)
    # The texts go no further than to the scorer: each couple once, then only its digest and its score.
    couples = keyed.groupBy("__couple").agg(F.first("premise").alias("premise"), F.first("sentence").alias("sentence"))
    scored = couples.select("__couple", scorer("premise", "sentence").alias("contradiction"))
    return keyed.drop("premise", "sentence").join(scored, "__couple").drop("__couple")


def worst_premise(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The source sentence that contradicts each sentence most, the first of equals; flagged from ``threshold`` on."""
    best = F.max(F.struct("contradiction", (-F.col("prem_pos")).alias("back"))).alias("b")
    out = scored.groupBy("pair_id", "pos").agg(best)
    return out.select("pair_id", "pos", F.col("b.contradiction").alias("contradiction"), (-F.col("b.back")).alias("prem_pos"), (F.col("b.contradiction") >= threshold).alias("contradicts"))


def contradiction_report(pairs: DataFrame, hyp: DataFrame, worst: DataFrame | None) -> DataFrame:
    """Counts per pair; without a scorer (``worst`` None) nothing is assessed."""
    n = hyp.groupBy("pair_id").agg(F.count("*").alias("n_sentences"))
    out = pairs.select("pair_id").distinct().join(n, "pair_id", "left")
    if worst is None:
        out = out.withColumns({"n_assessed": F.lit(0).cast("long"), "n_contradictions": F.lit(0).cast("long")})
    else:
        out = out.join(worst.groupBy("pair_id").agg(F.count("*").alias("n_assessed"), F.count_if("contradicts").alias("n_contradictions")), "pair_id", "left")
    return out.na.fill(0).withColumn("backend_supported", F.lit(worst is not None))
