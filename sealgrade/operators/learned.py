"""Learned rules applied to documents: confidence adjustment, class override.

Rules match by substring. An index of the rules (``substrings``) goes to the documents in rounds of bounded
size, so documents are neither shuffled nor multiplied, and a rule that matches nothing costs nothing
but its place in the index. Texts of classes that no rule is for are not searched. Correction rules of more than
a round share their words: texts are searched for the different words once, and the rounds compare numbers of words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sealgrade import vocab as V
from sealgrade.operators.patterns import PAIR
from sealgrade.operators.running import running_sums
from sealgrade.operators.substrings import (
    ROUND_BYTES, WORD_ROUNDS, NeedleIndex, chosen_rows, expand, finds, found_in, in_rounds, parts_of, where_read,
    with_counts, with_some,
)
from sealgrade.session import stage

_GAP = "\u0000"  # between file name and preview, so that no match spans both
#: Indicators of candidate rules that are looked at together.
_TOGETHER = 1 << 21
#: Rare indicators that a text must hold of a rule before all are looked up: a third of those needed, and no more than this.
_RARE = 1000


def _haystack(filename: str, preview: str, chars: int | None = None) -> Column:
    body = F.coalesce(F.col(preview), F.lit(""))
    body = F.substring(body, 1, chars) if chars else body
    return F.lower(F.concat(F.coalesce(F.col(filename), F.lit("")), F.lit(_GAP), body))


# --- keyword rules ----------------------------------------------------------

def match_keyword_rules(
    docs: DataFrame, rules: DataFrame, filename: str = "filename", preview: str = "preview",
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """Add ``keyword_factor`` (product of the multipliers of all matching rules)
    and ``keyword_reason`` (of the last matching rule with multiplier under 0.8)."""
    return _with_hits(docs, rules, filename, preview, round_bytes).withColumns({
        "keyword_factor": _weakened(F.lit(1.0)), "keyword_reason": _keyword_reason(F.col("_hit.last")),
    }).drop("_hit")


class KeywordIndex:
    """Keyword rules, the strong ones known by their place in order."""

    def __init__(self, rules: pa.Table):
        # nulls come first, as they do where Spark compares structs
        rules = rules.take(pc.sort_indices(
            rules, sort_keys=[(c, "ascending") for c in ("seq", "pos", "k", "n")], null_placement="at_start"))
        self.needles = NeedleIndex([k.encode("utf-8") for k in rules.column("k").to_pylist()])
        n = pc.fill_null(rules.column("n"), 0).to_numpy()
        #: Which of ``_COUNTS`` counts a rule, -1 for none.
        self.counted = np.where(n >= 2, np.minimum(n, 5) - 2, -1).astype(np.int64)
        self.rows = rules.combine_chunks()

    def hits(self, texts: pa.Array) -> pa.Array:
        """How many rules of each strength each text holds, and the last strong one."""
        sizes, which = found_in(self.needles, texts)
        row, wide = np.repeat(np.arange(len(texts)), sizes), len(_COUNTS)
        counted = self.counted[which]
        some = counted >= 0
        counts = np.bincount(row[some] * wide + counted[some], minlength=len(texts) * wide).reshape(-1, wide)
        last = np.full(len(texts), -1)
        strong = counted >= 1
        np.maximum.at(last, row[strong], which[strong])
        rows = self.rows.take(pa.array(np.maximum(last, 0), mask=last < 0)).combine_chunks()
        names = ["seq", "pos", "k", "n"]
        rule = pa.StructArray.from_arrays(
            [rows.column(c).combine_chunks() for c in names], names, mask=pa.array(last < 0))
        return pa.StructArray.from_arrays(
            [*[pa.array(counts[:, i]) for i in range(wide)], rule], [*_COUNTS, "last"], mask=pa.array(sizes == 0))


#: How many rules of two, three, four and more corrections a text holds.
_COUNTS = ("twos", "threes", "fours", "more")


def _with_hits(docs: DataFrame, rules: DataFrame, filename: str, preview: str, round_bytes: int) -> DataFrame:
    """Add ``_hit``: the ``_COUNTS`` and the ``last`` strong rule, null where no rule matches."""
    listed = rules.where(F.col("keyword").isNotNull()).select(
        F.col("first_seq").alias("seq"), F.col("first_pos").alias("pos"), F.col("keyword").alias("k"),
        F.col("correction_count").alias("n"))
    kind = StructType([*[StructField(c, LongType()) for c in _COUNTS], StructField("last", listed.schema)])

    def merge(found: Column) -> Column:
        return F.struct(*[F.sum(found[c]).alias(c) for c in _COUNTS], F.max(found["last"]).alias("last"))

    return in_rounds(
        docs, [_haystack(filename, preview)], listed, F.coalesce(F.octet_length("k"), F.lit(0)) + 32, KeywordIndex,
        KeywordIndex.hits, kind, "_hit", merge, round_bytes)


def _weakened(value: Column) -> Column:
    """``value`` times the multipliers of all matching rules. They only take the values 0.8, 0.7, 0.6 and 0.5,
    so their product is known from how many rules of each matched."""
    for base, count in zip((0.8, 0.7, 0.6, 0.5), _COUNTS, strict=True):
        value = value * F.pow(F.lit(base), F.coalesce(F.col(f"_hit.{count}"), F.lit(0)))
    return value


def _keyword_reason(rule: Column) -> Column:
    return F.when(rule.isNotNull(), F.format_string(
        "Documents with '%s' have been corrected %d times", rule["k"], rule["n"]))


# --- confidence adjustment --------------------------------------------------

def adjust_confidence(
    docs: DataFrame, accuracy: DataFrame, keyword_rules: DataFrame, patterns: DataFrame,
    filename: str = "filename", preview: str = "preview", round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """Add ``adjusted_confidence``, ``learned_review`` and ``learned_reason``.

    Accuracy is joined by class: one row a class, which goes to the documents. A context pattern of the document's class applies if the text
    holds two of its words. The reason is that of the last rule that asked for review.
    """
    low = accuracy.where(F.col("classification").isNotNull() & (F.col("accuracy") < V.ACCURACY_FLOOR)).select(
        F.col("classification").alias("_low_class"),
        F.struct(F.col("classification").alias("c"), F.col("accuracy").alias("a")).alias("_weak"),
    )
    words = patterns.where(F.col(PAIR[0]).isNotNull()).select(
        F.explode("common_indicators").alias("w"), F.col(PAIR[0]).alias("c"),
        F.col("first_seq").alias("o"), F.coalesce(F.col(PAIR[1]), F.lit("None")).alias("t"),
    )
    matched = _with_hits(docs, keyword_rules, filename, preview, round_bytes)
    body = F.lower(F.coalesce(F.col(preview), F.lit("")))
    pattern = lambda x: F.struct(x["o"].alias("o"), x["t"].alias("t"))
    hits = lambda p: F.aggregate(
        F.filter("_own", lambda x: pattern(x) == p), F.lit(0).cast("bigint"), lambda n, x: n + x["hits"])
    prepared = (
        with_counts(matched, body, words, ("o", "t"), ("classification", "c"), "w", "_own", round_bytes)
        .join(F.broadcast(low), F.col("classification") == F.col("_low_class"), "left")
        .withColumn("_similar", F.array_sort(F.filter(
            F.array_distinct(F.transform("_own", pattern)), lambda p: hits(p) >= 2)))
    )
    weak, similar = F.col("_weak"), F.col("_similar")
    weak_reason = F.when(weak.isNotNull(), F.format_string(
        "AI has %.1f%% accuracy for %s (below threshold)", weak["a"], weak["c"]))
    last = F.try_element_at(similar, F.lit(-1))
    similar_reason = F.when(last.isNotNull(), F.concat(
        F.lit("Similar documents have been reclassified as "), last["t"]))
    known = F.col("confidence") * F.when(weak.isNotNull(), F.lit(V.LOW_ACCURACY_FACTOR)).otherwise(F.lit(1.0))
    raw = _weakened(known) * F.pow(F.lit(V.CONTEXT_FACTOR), F.size(similar))
    reason = F.coalesce(similar_reason, _keyword_reason(F.col("_hit.last")), weak_reason)
    return prepared.withColumns({
        "adjusted_confidence": F.greatest(
            F.lit(V.MIN_ADJUSTED), F.least(F.lit(V.MAX_ADJUSTED), raw)),
        "learned_reason": reason,
        "learned_review": reason.isNotNull(),
    }).drop("_low_class", "_own", "_weak", "_similar", "_hit")


# --- class override ---------------------------------------------------------

def override_rules(feedback: DataFrame) -> DataFrame:
    """Correction rules: entries not approved (a missing mark counts) with at
    least three indicators, since no match below three is ever enough."""
    return feedback.where(
        ~F.coalesce("approved", F.lit(False)) & F.col("original_classification").isNotNull()
        & (F.size(F.coalesce("key_indicators", F.array().cast("array<string>"))) >= 3)
    ).select(
        "seq", F.col("original_classification").alias("rule_from"),
        F.col("corrected_classification").alias("rule_to"),
        F.transform("key_indicators", lambda k: F.lower(k)).alias("indicators"),
        F.coalesce("feedback_notes", F.lit("")).alias("notes"),
    )


class Rules:
    """Correction rules in order, each under those of its indicators that fewest rules have.

    A rule that needs ``t`` of its ``n`` indicators has ``k`` hits among any ``n - t + k`` of them, so
    it is looked up by its rarest ones: indicators shared by most rules lead to no rule, and a text that holds fewer than
    ``k`` of the rare ones is not compared further. ``rules`` has a list of numbers a rule, of ``words`` numbers in
    order of rarity; ``total`` says of how many indicators they are, nulls, which never hit, included.
    """

    def __init__(self, rules: pa.Table, total: np.ndarray, size: np.ndarray, ids: np.ndarray, words: int):
        self.total, self.size, self.words = total, size, max(1, words)
        self.start = np.cumsum(size) - size
        self.needed = np.maximum(3, -(-total // 2))
        self.rare = np.minimum(_RARE, np.maximum(1, self.needed // 3))
        self.classes = pc.unique(rules.column("rule_from"))
        of = pc.index_in(rules.column("rule_from"), value_set=self.classes).to_numpy().astype(np.int64)
        self.payload = pa.StructArray.from_arrays(
            [rules.column("seq").combine_chunks(), rules.column("rule_to").combine_chunks(), rules.column("notes").combine_chunks()],
            ["seq", "to", "notes"])
        rule = np.repeat(np.arange(len(size)), size)
        self.ids = ids[np.lexsort((ids, rule))]
        place = np.arange(len(ids)) - np.repeat(self.start, size)
        entered = np.flatnonzero(place < np.repeat(size - self.needed + self.rare, size))
        # by class and word; an indicator that a rule has twice counts twice
        under = of[rule[entered]] * self.words + self.ids[entered]
        pairs, self.weight = np.unique(under * max(1, len(size)) + rule[entered], return_counts=True)
        under, self.rules = np.divmod(pairs, max(1, len(size)))
        self.under, first = np.unique(under, return_index=True)
        self.first = np.r_[first, len(under)].astype(np.int64)

    def first_of(self, held: np.ndarray, wanted: np.ndarray) -> pa.Array:
        """For each text its first matching rule with how many indicators it holds, or null. ``held`` has text times
        ``words`` plus word, in order, for the words of each; ``wanted`` is the place of a text's class."""
        rows, n = len(wanted), self.words
        row, word = np.divmod(held, n)
        best, hits = np.full(rows, len(self.size)), np.zeros(rows, np.int64)
        key = wanted[row] * n + word
        at = np.minimum(np.searchsorted(self.under, key), max(0, len(self.under) - 1))
        good = np.flatnonzero((self.under[at] == key) & (wanted[row] >= 0)) if len(self.under) else np.empty(0, np.int64)
        row, at = row[good], at[good]
        lead = self.first[at + 1] - self.first[at]
        # whole texts, as many at once as have _TOGETHER entries or pairs with rules
        done, size, so_far = 0, max(1, len(self.size)), np.cumsum(lead)
        while done < len(row):
            last = max(done + 1, int(np.searchsorted(so_far, _TOGETHER + so_far[done] - lead[done])))
            end = min(row[last - 1] + 1, row[done] + max(1, _TOGETHER // size))
            last = int(np.searchsorted(row, end))
            of, entry = expand(self.first[at[done:last]], lead[done:last])
            rare = np.bincount((row[done:last][of] - row[done]) * size + self.rules[entry], self.weight[entry])
            pair = np.flatnonzero(rare)
            pair = pair[rare[pair] >= self.rare[pair % size]]
            self._count(pair + row[done] * size, held, n, best, hits)
            done = last
        some = best < len(self.size)
        payload = self.payload.take(pa.array(best, mask=~some))
        fields = [payload.field(i) for i in range(3)]
        return pa.StructArray.from_arrays(
            [*fields, pa.array(hits), pa.array(np.where(some, np.r_[self.total, 0][best], 0))], ["seq", "to", "notes", "hits", "n"], mask=pa.array(~some))

    def _count(self, pair: np.ndarray, held: np.ndarray, n: int, best: np.ndarray, hits: np.ndarray) -> None:
        text, rule = np.divmod(pair, len(self.size))
        done = 0
        while done < len(pair):
            last = max(done + 1, int(np.searchsorted(np.cumsum(self.size[rule[done:]]), _TOGETHER)) + done)
            t, r = text[done:last], rule[done:last]
            of, at = expand(self.start[r], self.size[r])
            key = t[of] * n + self.ids[at]
            found = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key
            count = np.bincount(of[found], minlength=len(t))
            good = np.flatnonzero(count >= self.needed[r])
            # pairs are in order: a text's first one has its first rule
            of, at = np.unique(t[good], return_index=True)
            good = good[at]
            less = r[good] < best[of]
            best[of[less]], hits[of[less]] = r[good[less]], count[good[less]]
            done = last


class RuleIndex(Rules):
    """Rules with an index of their different ``words``; ``ids`` gives each indicator's place in these, -1 for a null."""

    def __init__(self, rules: pa.Table, counts: dict[int, int] | None, words: list[bytes], ids: np.ndarray):
        total = np.array(pc.list_value_length(rules.column("indicators")).to_pylist(), np.int64)
        some = ids >= 0
        rule = np.repeat(np.arange(len(total)), total)[some]
        order = np.argsort(np.bincount(ids[some], minlength=len(words)), kind="stable")
        rank = np.argsort(order)
        super().__init__(rules, total, np.bincount(rule, minlength=len(total)), rank[ids[some]], len(words))
        self.needles = NeedleIndex([words[i] for i in order], counts)

    def first_rules(self, texts: pa.Array, keywords: pa.ListArray, classes: pa.Array) -> pa.Array:
        """For each text its first matching rule with how many indicators it holds, or null."""
        wanted, row, word = class_words(self.needles, self.classes, texts, keywords, classes)
        return self.first_of(row * self.words + word, wanted)


def class_words(
    needles: NeedleIndex, values: pa.Array, texts: pa.Array, keywords: pa.ListArray, classes: pa.Array,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of ``values`` each text's class is, and, in order, the different pairs of a text of such a class and a
    word that it holds or has as a keyword."""
    wanted, chosen = chosen_rows(classes, values)
    texts, keywords = texts.take(pa.array(chosen)), keywords.take(pa.array(chosen))
    n = max(1, len(needles.size))
    sizes, word = found_in(needles, texts)
    # a keyword is a word that it holds and that is as long
    different = pc.list_flatten(keywords).dictionary_encode()
    holds, which = found_in(needles, different.dictionary)
    of = np.repeat(np.arange(len(holds)), holds)
    length = pc.fill_null(pc.binary_length(different.dictionary), 0).to_numpy(zero_copy_only=False)
    equal = needles.size[which] == length[of]
    same = np.full(len(holds) + 1, -1)
    same[of[equal]] = which[equal]
    own = same[pc.fill_null(different.indices, len(holds)).to_numpy(zero_copy_only=False)]
    holder = pc.list_parent_indices(keywords).to_numpy(zero_copy_only=False)
    held = np.unique(np.r_[np.repeat(np.arange(len(texts)), sizes) * n + word, (holder * n + own)[own >= 0]])
    row, word = np.divmod(held, n)
    return wanted, chosen[row], word


#: What is found of a rule.
_RULE = StructType([
    StructField("seq", LongType()), StructField("to", StringType()), StructField("notes", StringType()),
    StructField("hits", LongType()), StructField("n", LongType())])
#: Rules of one ``seq`` are in this order.
_ORDER = ("seq", "rule_to", "notes")


def _first_rule(docs: DataFrame, inputs: list[Column], rules: DataFrame, round_bytes: int) -> DataFrame:
    """Add ``_rule``: the first rule of the class whose indicators text and keywords hold often enough; these are the ``inputs``."""
    rules = stage(rules)
    size = F.length("notes") + F.length(F.array_join("indicators", " ")) + 8 * F.size("indicators") + 64
    if parts_of(rules, size, round_bytes) > 1:
        return _first_rule_in_parts(docs, inputs, rules, round_bytes)
    part = rules.toArrow().sort_by([(c, "ascending") for c in _ORDER])
    listed = pc.list_flatten(part.column("indicators")).combine_chunks().cast(pa.binary())
    words = pc.unique(listed).drop_null()
    ids = pc.fill_null(pc.index_in(listed, value_set=words), -1).to_numpy().astype(np.int64)
    index = RuleIndex(part, None, words.to_pylist(), ids)
    return where_read(docs, inputs, index, RuleIndex.first_rules, _RULE, "_rule")


def _numbered(rules: DataFrame, round_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The different indicators as ``word, id``, rarest first, and the rules as ``_part``, the round that they are taken in by
    their order, ``ids``, and ``n``, how many indicators they have. A rule without the hits it needs is left out."""
    rules = rules.withColumn("_rule_id", F.monotonically_increasing_id())
    listed = rules.select("_rule_id", F.explode("indicators").alias("word")).where(F.col("word").isNotNull())
    words = stage(listed.groupBy("word").agg(F.count(F.lit(1)).alias("share")).orderBy("share", "word").select(
        "word", F.monotonically_increasing_id().alias("id")))
    ids = listed.join(words, "word").groupBy("_rule_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    rest = rules.select("_rule_id", "seq", "rule_from", "rule_to", "notes", F.size("indicators").cast("bigint").alias("n"))
    rest = rest.join(ids, "_rule_id").where(F.size("ids") >= F.greatest(F.lit(3), F.ceil(F.col("n") / 2)))
    # nulls come last, as they do where rules are sorted in one round
    last = {f"_no_{c}": F.col(c).isNull() for c in _ORDER}
    order = [x for c in _ORDER for x in (f"_no_{c}", c)]
    summed = running_sums(
        rest.withColumns({"_all": F.lit(0), **last}), ["_all"], [*order, "_rule_id"],
        {"_bytes": (F.length("notes") + 8 * F.size("ids") + 64).cast("bigint")})
    return words, summed.withColumn("_part", F.floor(F.col("_bytes") / round_bytes)).drop("_all", "_bytes", *last)


def _first_rule_in_parts(docs: DataFrame, inputs: list[Column], rules: DataFrame, round_bytes: int) -> DataFrame:
    """``_first_rule`` with rules of more than one round.

    Texts are searched for the rules' different words once and then stand as lists of numbers. Rules are taken in their
    order, and a text that found its rule takes no part in the rounds that follow.
    """
    words, numbered = (stage(x) for x in _numbered(rules, round_bytes))
    values = pa.array([r[0] for r in rules.select("rule_from").distinct().collect()], pa.string())  # classes
    kept = stage(docs.withColumn("_row", F.monotonically_increasing_id()))
    held = _held_words(with_some(kept, inputs[2], rules, "rule_from"), inputs, words, values, WORD_ROUNDS * round_bytes)
    some = [r[0] for r in numbered.select("_part").distinct().orderBy("_part").collect()]  # one a round
    found: DataFrame | None = None
    for part in some:
        own = numbered.where(F.col("_part") == part).toArrow().sort_by([(c, "ascending") for c in (*_ORDER, "_rule_id")])
        left = held if found is None else held.join(found.select("_row"), "_row", "left_anti")
        got = finds(left, "_row", [F.col("kind"), F.col("ids")], NumberedRules(own), NumberedRules.first_rules, _RULE)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return kept.withColumn("_rule", F.lit(None).cast(_RULE)).drop("_row")
    return kept.join(found.withColumnRenamed("found", "_rule"), "_row", "left").drop("_row")


def _held_words(texts: DataFrame, inputs: list[Column], words: DataFrame, values: pa.Array, round_bytes: int) -> DataFrame:
    """``_row, kind, ids``, written: of each text of a class in ``values`` the class and the words that it holds."""
    kind = StructType([StructField("kind", StringType()), StructField("ids", ArrayType(LongType()))])
    n = parts_of(words, F.octet_length("word") + 32, round_bytes)

    def find(shared: tuple[NeedleIndex, np.ndarray], bodies: pa.Array, keywords: pa.ListArray, classes: pa.Array) -> pa.Array:
        needles, ids = shared
        _, row, word = class_words(needles, values, bodies, keywords, classes)
        sizes = np.bincount(row, minlength=len(bodies))
        lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.array(ids[word]))
        return pa.StructArray.from_arrays([classes, lists], ["kind", "ids"], mask=pa.array(sizes == 0))

    found = []
    for part in range(n):
        own = words.where(F.pmod(F.xxhash64("id"), F.lit(n)) == part).toArrow()
        index = NeedleIndex([w.encode("utf-8") for w in own.column("word").to_pylist()]), own.column("id").to_numpy()
        found.append(finds(texts, "_row", inputs, index, find, kind).select("_row", "found.*"))
    if n == 1:
        return found[0]
    every = reduce(DataFrame.unionByName, found).groupBy("_row", "kind")
    return stage(every.agg(F.flatten(F.collect_list("ids")).alias("ids")))


class NumberedRules(Rules):
    """Rules whose indicators are numbers of words, as texts' words are."""

    def __init__(self, rules: pa.Table):
        size = pc.list_value_length(rules.column("ids")).to_numpy().astype(np.int64)
        #: The numbers that occur here, in order.
        self.known, ids = np.unique(pc.list_flatten(rules.column("ids")).to_numpy(), return_inverse=True)
        super().__init__(rules, rules.column("n").to_numpy(), size, ids, len(self.known))

    def first_rules(self, classes: pa.Array, lists: pa.ListArray) -> pa.Array:
        """For each text its first matching rule with how many indicators it holds, or null."""
        wanted, _ = chosen_rows(classes, self.classes)
        ids, row = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(self.known, ids), max(0, len(self.known) - 1))
        good = self.known[at] == ids if len(self.known) else np.zeros(len(ids), bool)
        return self.first_of(np.sort(row[good] * self.words + at[good]), wanted)


def apply_override(
    docs: DataFrame, feedback: DataFrame, filename: str = "filename", preview: str = "preview",
    keywords: str = "all_keywords", preview_chars: int | None = None, round_bytes: int = ROUND_BYTES,
    note_chars: int | None = 100,
) -> DataFrame:
    """Add ``learned_classification``, ``learned_confidence``, ``was_overridden``
    and ``override_reason``.

    The first correction of the document's class applies whose indicators are
    present often enough: three, or half of them if that is more. An indicator
    may stand in the preview (its first ``preview_chars``, if given), in the file name,
    or equal a keyword. The reason quotes ``note_chars`` of the rule's notes, all with None.
    """
    own = F.transform(F.coalesce(F.col(keywords), F.array().cast("array<string>")), lambda k: F.lower(k))
    rules = override_rules(feedback)
    if note_chars is not None:
        # what is not quoted need not travel
        rules = rules.withColumn("notes", F.substring("notes", 1, note_chars))
    matched = _first_rule(
        docs, [_haystack(filename, preview, preview_chars), own, F.col("classification")], rules, round_bytes)
    rule = F.col("_rule")
    hit = rule.isNotNull()
    return matched.withColumns({
        "learned_classification": F.when(hit, rule["to"]).otherwise(F.col("classification")),
        "learned_confidence": F.when(
            hit, F.least(F.lit(V.OVERRIDE_CEILING), F.col("confidence") + V.OVERRIDE_BONUS)
        ).otherwise(F.col("confidence")),
        "was_overridden": hit,
        "override_reason": F.when(hit, F.format_string(
            "Learned rule applied: '%s' → '%s'. Matched %d/%d indicators. Human feedback: %s",
            F.col("classification"), F.coalesce(rule["to"], F.lit("None")), rule["hits"],
            rule["n"], rule["notes"],
        )),
    }).drop("_rule")


# --- texts ------------------------------------------------------------------

def prompt_enhancements(frequent: DataFrame, patterns: DataFrame, n: int = 3) -> DataFrame:
    """Warnings of the ``n`` most frequent pairs and the first ``n`` rules, as
    ``key, text, position``. A second warning for the same class replaces the
    text of the first and keeps its place."""
    names = {c: F.coalesce(F.col(c), F.lit("None")) for c in PAIR}
    top = frequent.orderBy(F.col("count").desc(), "first_seq").limit(n)
    warnings = top.select(
        F.concat(F.lit("warning_"), names[PAIR[0]]).alias("key"),
        F.format_string(
            "⚠️ LEARNED PATTERN: Documents initially classified as '%s' have been corrected to "
            "'%s' %d times (%.1f%% of feedback). Carefully verify this classification.",
            names[PAIR[0]], names[PAIR[1]], F.col("count"), F.col("percentage"),
        ).alias("text"),
        F.struct((-F.col("count")).alias("a"), F.col("first_seq").alias("b")).alias("o"),
    ).groupBy("key").agg(F.max_by("text", "o").alias("text"), F.min("o").alias("o"))
    rules = patterns.orderBy("first_seq").limit(n).select(
        F.concat(F.lit("rule_"), names[PAIR[0]], F.lit("_to_"), names[PAIR[1]]).alias("key"),
        F.col("rule").alias("text"),
        F.struct(F.lit(1).cast("bigint").alias("a"), F.col("first_seq").alias("b")).alias("o"),
    )
    return warnings.unionByName(rules).select(
        "key", "text", F.col("o.a").alias("group"), F.col("o.b").alias("position"))


def learned_lead_in(enhancements: DataFrame, accuracy: DataFrame, examples: DataFrame) -> DataFrame:
    """One row of text: learned rules, accuracy per class, two examples per class.

    At most six rules, four classes and eight examples meet here."""
    def joined(df: DataFrame, order, line: Column) -> Column:
        return F.coalesce(
            df.agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))),
                lambda x: x["l"]), "\n")).scalar(), F.lit(""))

    place = F.array_position(F.array(*[F.lit(c) for c in V.CLASSES]), F.col("classification"))
    rules = joined(
        enhancements, F.struct("group", "position"), F.concat(F.lit("- "), F.col("text")))
    history = joined(
        accuracy.where(F.col("classification").isin(*V.CLASSES)), place,
        F.format_string("- %s: %.1f%% accuracy (%d/%d correct)", F.col("classification"),
                        F.col("accuracy"), F.col("correct"), F.col("total_reviews")))
    shown = joined(
        examples.where(F.col("classification").isin(*V.CLASSES) & (F.col("rank") <= 2)),
        F.struct(place.alias("p"), F.col("rank")),
        F.concat(
            F.when(F.col("rank") == 1, F.concat(
                F.lit("\n**✅ VERIFIED "), F.upper("classification"), F.lit(" EXAMPLES:**\n"))
            ).otherwise(F.lit("")),
            F.format_string("- '%s' → %s (%s)", "filename", "classification", "confidence")))
    spark = enhancements.sparkSession
    head = F.lit("\n**🧠 LEARNED FROM HUMAN FEEDBACK:**\n\n")
    return spark.range(1).select(F.concat(
        F.when(rules != "", F.concat(head, rules)).otherwise(F.lit("")),
        F.when(history != "", F.concat(F.lit("\n\n**📊 HISTORICAL ACCURACY:**\n"), history))
        .otherwise(F.lit("")),
        F.when(shown != "", F.concat(F.lit("\n"), shown)).otherwise(F.lit("")),
    ).alias("lead_in"))
