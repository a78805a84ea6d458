"""Raise the denial rate with evidence-backed denials.

Selection is a chain of cutoffs. A histogram of rules and draws gives the draw up to which each
rule's quota reaches; "not taken by an earlier rule" is the order of one CASE expression.
So the selected set is a projection of the feature table: no anti-joins, no growing plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.denials import appeal, base_date, denial_date, denial_id
from claimspark.functions.draws import draw
from claimspark.functions.text import row_json
from claimspark.functions.values import days_between, format_date, parse_date
from claimspark.operators.aggregates import diagnosis_profile, max_numeric_suffix, procedure_profile
from claimspark.operators.duplicates import duplicate_evidence_table
from claimspark.operators.joins import HOT_ROWS, hot_keys_by_column, keep_first, lookup_join, suffix_overlap
from claimspark.operators.ordering import exact_quantiles, global_rank
from claimspark.operators.quotas import Quotas, Take
from claimspark.operators.rules import (
    HIGH_COST_QUANTILE,
    NON_COVERED_QUANTILE,
    NON_COVERED_WORDS,
    TIMELY_DAYS,
    WATCHED_DEPARTMENTS,
    RuleSpec,
    denial_rules,
    not_denied,
)
from claimspark.operators.sampling import find_cut
from claimspark.session import materialize
from claimspark.sources.tables import ClaimTables

TARGET_RATIO = 0.30


def _visit_key() -> Column:
    """The encounter as a join key that is never null: claims and encounters without identifier meet as if it were one."""
    return F.coalesce(F.concat(F.lit("="), F.col("encounter_id").cast("string")), F.lit(""))


def claim_features(tables: ClaimTables, z_prefix: str = "Z", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One wide row per claim: claim, encounter, patient and clinical summaries.

    The narrow claims meet their patients first. Encounters, procedures and diagnoses follow by one key, by
    which the summaries are grouped already, so that no wide row is moved.
    """
    hot = hot_keys_by_column(tables.claims, ["encounter_id", "patient_id"], hot_rows)
    claims = tables.claims.withColumn("claim_billing_dt", parse_date(F.col("claim_billing_date")))
    visits = tables.encounters.withColumns(
        {"visit_dt": parse_date(F.col("visit_date")), "discharge_dt": parse_date(F.col("discharge_date"))}
    )
    people = tables.patients.withColumn("registration_dt", parse_date(F.col("registration_date")))

    def by_visit(table: DataFrame) -> DataFrame:
        """The table with the key in the place of the encounter, and names that claims don't have."""
        return suffix_overlap(claims, table.withColumn("_visit", _visit_key()).drop("encounter_id"), ["_visit"], "_enc")

    def summary(profile: DataFrame) -> DataFrame:
        return suffix_overlap(claims, profile.withColumnRenamed("encounter_id", "_visit"), ["_visit"], "_enc")

    def keyed(table: DataFrame) -> DataFrame:
        return table.where(F.col("encounter_id").isNotNull()).withColumn("encounter_id", _visit_key())

    sides = [
        by_visit(visits),
        summary(procedure_profile(keyed(tables.procedures))),
        summary(diagnosis_profile(keyed(tables.diagnoses), z_prefix)),
    ]
    of_visit = [c for side in sides for c in side.columns if c != "_visit"]
    taken = {*claims.columns, *of_visit} - {"patient_id"}
    people = people.select([F.col(c).alias(f"{c}_pat") if c in taken else F.col(c) for c in people.columns])
    spread = {"spread_by": ["claim_id"]}
    joined = lookup_join(
        claims.withColumn("_visit", _visit_key()), people, "patient_id", null_safe=True, hot=hot["patient_id"], **spread
    )
    hot_visits = hot["encounter_id"] if hot["encounter_id"] is None else hot["encounter_id"].select(_visit_key().alias("_visit"))
    for side in sides:
        joined = lookup_join(joined, side, "_visit", hot=hot_visits, **spread)
    of_patient = [c for c in people.columns if c != "patient_id"]
    return joined.select(*claims.columns, *of_visit, *of_patient).withColumns(
        {
            "days_to_file": days_between(F.col("claim_billing_dt"), F.col("visit_dt")),
            "proc_count": F.coalesce("proc_count", F.lit(0)),
        }
    )


@dataclass(frozen=True)
class Sizes:
    total: int
    denied: int
    target: int
    need: int
    quota: int


def target_sizes(claims: DataFrame, categories: int = 9, ratio: float = TARGET_RATIO) -> DataFrame:
    """One row: claims, denied now, denied wanted, new denials needed, quota per category."""
    counts = claims.agg(
        F.count(F.lit(1)).alias("total_claims"), F.count_if(F.col("claim_status") == "Denied").alias("current_denied")
    )
    target = F.ceil(F.col("total_claims") * F.lit(float(ratio)))
    need = F.greatest(F.lit(0), target - F.col("current_denied"))
    return counts.select(
        "*",
        target.alias("target_denied"),
        need.alias("need_new"),
        F.ceil(need / F.lit(categories)).alias("category_quota"),
    )


def _sizes(claims: DataFrame, categories: int, ratio: float) -> Sizes:
    return Sizes(*target_sizes(claims, categories, ratio).collect()[0])


def candidate_pool(features: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Claims that may still be denied, one row per claim id, with draw and duplicate evidence.

    The wide rows are written once and not moved: claim ids are counted in the written table, and only rows whose id
    comes again are put in order. Duplicates are found on a few of their columns and come back as a table of the
    repeating claims only, whose known key lets Spark leave that join out where no evidence is asked for.
    """
    open_claims = features.where(not_denied() & F.col("claim_id").isNotNull()).withColumn("_draw", draw(F.col("claim_id")))
    pool = materialize(open_claims, "claim-pool")
    again = pool.groupBy("claim_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("claim_id")
    again = materialize(again, "claims-again")
    if again.limit(1).count():
        order = [F.col(c).asc_nulls_last() for c in ("claim_billing_dt", "billed_amount", "encounter_id", "patient_id")]
        firsts = keep_first(pool.join(again, "claim_id", "left_semi"), ["claim_id"], order)
        pool = materialize(pool.join(again, "claim_id", "left_anti").unionByName(firsts), "claim-pool")
    repeats = materialize(duplicate_evidence_table(pool, hot_rows), "repeats")
    return lookup_join(pool, repeats.dropDuplicates(["claim_id"]), "claim_id")


def pool_rules(
    pool: DataFrame,
    words: Sequence[str] = NON_COVERED_WORDS,
    departments: Sequence[str] = WATCHED_DEPARTMENTS,
) -> list[RuleSpec]:
    high, non_covered = exact_quantiles(pool, "billed_amount", [HIGH_COST_QUANTILE, NON_COVERED_QUANTILE])
    return denial_rules(high, non_covered, words, departments)


def rule_flags(pool: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """Narrow table for the selection passes: id, draw, delay and one boolean per rule; written once.

    The passes read this table many times, so the text and list columns of the pool are
    evaluated only here. The rule that asks for duplicate evidence is looked at apart, so that only
    booleans meet that evidence.
    """
    flags = {i: F.coalesce(rule.predicate, F.lit(False)).alias(f"_rule{i}") for i, rule in enumerate(rules)}
    repeating = [i for i, rule in enumerate(rules) if rule.by_duplicates]
    plain = pool.select("claim_id", "_draw", "days_to_file", *[f for i, f in flags.items() if i not in repeating])
    for i in repeating:
        hit = pool.select(F.col("claim_id").alias("_repeat"), flags[i]).where(f"_rule{i}")
        plain = plain.join(hit, F.col("claim_id") == F.col("_repeat"), "left").drop("_repeat").withColumn(f"_rule{i}", F.coalesce(f"_rule{i}", F.lit(False)))
    return materialize(plain.select("claim_id", "_draw", "days_to_file", *[f"_rule{i}" for i in flags]), "rule-flags")


@dataclass(frozen=True)
class _Delays:
    """The longest filing delays up to a number of rows: all above `day`, and `on_day` rows of that day."""

    day: int | None
    on_day: int

    @property
    def above(self) -> Column:
        return F.lit(True) if self.day is None else F.col("days_to_file") > self.day

    @property
    def edge(self) -> Column:
        return F.lit(False) if self.day is None else F.col("days_to_file") == self.day


class Selection:
    """Which pool rows go to which rule, as an ordered list of predicates over the flags."""

    def __init__(self, flags: DataFrame, rules: Sequence[RuleSpec]) -> None:
        self.flags, self.rules = flags, list(rules)
        self._picks: list[tuple[int, Column, bool]] = []
        self._counts: list[int] | None = None
        self._marks: DataFrame | None = None

    def add_rows(self, picks: DataFrame) -> None:
        """Give rules the claims of a table of claim_id and rule."""
        self._marks = materialize(picks.select("claim_id", F.col("rule").alias("_picked")), "picked-rows")
        self.flags = materialize(self.flags.join(self._marks, "claim_id", "left"), "rule-flags")
        for i in range(len(self.rules)):
            self.add(i, F.col("_picked") == i)

    def add(self, rule: int, predicate: Column, fallback: bool = False) -> None:
        self._picks.append((rule, predicate, fallback))
        self._counts = None

    def _chain(self, value_of) -> Column:
        chain = F.when(F.lit(False), value_of(0, False))
        for rule, predicate, fallback in self._picks:
            chain = chain.when(predicate, value_of(rule, fallback))
        return chain

    @property
    def category(self) -> Column:
        """Index of the rule that takes the row; null if none does."""
        return self._chain(lambda rule, fallback: F.lit(rule))

    def left_over(self) -> DataFrame:
        return self.flags.where(self.category.isNull())

    def counts(self) -> list[int]:
        """Rows taken per rule."""
        if self._counts is None:
            rows = self.flags.groupBy(self.category.alias("c")).count().where("c is not null").collect()  # one per rule
            found = {r["c"]: r["count"] for r in rows}
            self._counts = [found.get(i, 0) for i in range(len(self.rules))]
        return self._counts

    def _longest_delays(self, rule: int, n: int) -> _Delays:
        """Where the n longest delays end. Delays of `TIMELY_DAYS` or more come first by being longer, shorter ones only fill up."""
        by_days = Window.orderBy(F.col("days_to_file").desc())
        edge = (
            self.flags.where(F.col(f"_rule{rule}"))
            .groupBy("days_to_file")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("upto", F.sum("n").over(by_days))  # one row per number of days
            .where(F.col("upto") >= n)
            .orderBy(F.col("days_to_file").desc())
            .limit(1)
            .collect()
        )
        return _Delays(edge[0]["days_to_file"], n - edge[0]["upto"] + edge[0]["n"]) if edge else _Delays(None, 0)

    def take_in_order(self, quota: int, only: Sequence[int] | None = None) -> None:
        """Each rule in order (or some of them) takes its quota from what the earlier ones left, and the delay rule the longest
        delays of all its candidates; claims that another rule has are not replaced there."""
        order = range(len(self.rules)) if only is None else only
        late = [i for i in order if self.rules[i].by_filing_days]
        self._delays = {i: self._longest_delays(i, quota) for i in late}
        bits = [F.col(f"_rule{i}") for i in range(len(self.rules))]
        for i in late:
            bits += [bits[i] & self._delays[i].above, bits[i] & self._delays[i].edge]
        mask = sum((b.cast("int") * F.lit(1 << i) for i, b in enumerate(bits)), F.lit(0))
        self._quotas = Quotas(self.flags.withColumn("_mask", mask))
        takes: list[Take] = []
        for i in order:
            if i in late:
                above = len(self.rules) + 2 * late.index(i)
                takes += [Take(above, None), Take(above + 1, self._delays[i].on_day, of_all=True)]
            else:
                takes.append(Take(i, quota))
        self._takes, self._of_take = takes, [i for i in order for _ in range(2 if i in late else 1)]
        self._play()

    def take_more(self, wanted: Sequence[tuple[int, int]]) -> None:
        """Further rows for some rules, in this order, after `take_in_order`."""
        self._takes = self._takes + [Take(rule, n) for rule, n in wanted]
        self._of_take = self._of_take + [rule for rule, _ in wanted]
        self._play()

    def counts_after(self, wanted: Sequence[tuple[int, int]]) -> list[int]:
        """Rows per rule if `wanted` were taken too."""
        _, sizes = self._quotas.cuts(self._takes + [Take(rule, n) for rule, n in wanted])
        found = [0] * len(self.rules)
        for rule, size in zip(self._of_take + [r for r, _ in wanted], sizes):
            found[rule] += size
        return found

    def _play(self) -> None:
        cuts, _ = self._quotas.cuts(self._takes)
        self._picks = []
        at_edge: set[int] = set()
        for rule, take, cut in zip(self._of_take, self._takes, cuts):
            flag = F.col(f"_rule{rule}")
            if rule in self._delays:
                flag = flag & (self._delays[rule].edge if rule in at_edge else self._delays[rule].above)
                at_edge.add(rule)
            # the cut first: a rule is looked at only for claims whose draw is small enough
            self.add(rule, cut.takes(F.col("_draw"), F.col("claim_id")) & flag)
        self._counts = self.counts_after([])

    def rows(self, pool: DataFrame) -> DataFrame:
        """Selected pool rows with `category_no`, `category`, `profile`, `reason_text` and `evidence`."""

        def of_rule(values: Sequence[str]) -> Column:
            return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("category_no") + 1)

        if self._marks is None:
            # before the duplicate evidence is joined, only rows stay that a pick takes if they are duplicates
            perhaps = {f"_rule{i}": F.lit(True) if rule.by_duplicates else rule.predicate for i, rule in enumerate(self.rules)}
            pool = pool.withColumns(perhaps).where(self.category.isNotNull()).drop(*perhaps)
        flagged = pool.withColumns({f"_rule{i}": rule.predicate for i, rule in enumerate(self.rules)})
        if self._marks is not None:
            flagged = flagged.join(self._marks, "claim_id", "left")
        evidence = F.when(F.col("_fallback"), row_json(F.lit(True).alias("fallback"), F.col("billed_amount")))
        for i, rule in enumerate(self.rules):
            evidence = evidence.when(F.col("category_no") == i, rule.evidence)
        return (
            flagged.withColumn("category_no", self.category)
            .withColumn("_fallback", self._chain(lambda rule, fallback: F.lit(fallback)))
            .where(F.col("category_no").isNotNull())
            .withColumns(
                {
                    "category": of_rule([r.code for r in self.rules]),
                    "reason_text": of_rule([r.description for r in self.rules]),
                    "profile": of_rule([r.profile for r in self.rules]),
                    "evidence": evidence,
                }
            )
            .drop(*[f"_rule{i}" for i in range(len(self.rules))], "_fallback", "_picked")
        )


def priority_pass(selection: Selection, quota: int) -> None:
    """Each rule in order takes its quota from what the earlier ones left."""
    selection.take_in_order(quota)


def shortage_pass(selection: Selection, quota: int, need: int) -> None:
    """Rules below their quota take more while the need is not met.

    The filing-delay rule is left out: a shorter list of the longest delays holds no new claim.
    """
    wanted: list[tuple[int, int]] = []
    for i, rule in enumerate(selection.rules):
        counts = selection.counts_after(wanted)
        if not rule.by_filing_days and counts[i] < quota and sum(counts) < need:
            wanted.append((i, quota - counts[i]))
    if wanted:
        selection.take_more(wanted)


def robin_draw(rule: Column) -> Column:
    """A rule's own order of its free candidates."""
    return draw(F.concat_ws(":", rule.cast("string"), F.col("claim_id")), "robin")


def round_robin_turns(candidates: DataFrame) -> DataFrame:
    """Deals claims that several rules want, one per rule and round, without two rules ever reaching for the same claim.

    `candidates` has claim_id and rule. Each rule ranks its candidates by a draw of its own; a claim belongs to
    the rule that ranks it best, at a tie to the first one. Ranked again, a rule's claims are its turns.
    Gives one row per claim: claim_id, rule and turn. Two ranks over the cluster, however long the queues are.
    """

    def ranked(rows: DataFrame, order: Column, name: str) -> DataFrame:
        placed = global_rank(rows, [F.col("rule"), order, F.col("claim_id")], "place")
        first = placed.groupBy("rule").agg(F.min("place").alias("_first"))  # one row per rule
        return placed.join(F.broadcast(first), "rule").withColumn(name, F.col("place") - F.col("_first") + 1).drop("place", "_first")

    wishes = ranked(candidates.select("claim_id", "rule", robin_draw(F.col("rule")).alias("_own")), F.col("_own"), "wish")
    owned = wishes.groupBy("claim_id").agg(F.min(F.struct("wish", "rule")).alias("best"))
    return ranked(owned.select("claim_id", "best.rule", "best.wish"), F.col("wish"), "turn").drop("wish")


def robin_quotas(sizes: Sequence[int], need: int) -> list[int]:
    """How many turns each rule gets until `need` claims are dealt, given how many it has."""
    turns = 0
    step = 1 << max(sizes, default=0).bit_length()
    while step:  # the most full rounds that don't pass the need
        if sum(min(n, turns + step) for n in sizes) <= need and turns + step <= max(sizes, default=0):
            turns += step
        step //= 2
    dealt = [min(n, turns) for n in sizes]
    for i, n in enumerate(sizes):
        if sum(dealt) < need and n > turns:
            dealt[i] += 1
    return dealt


def round_robin_pass(selection: Selection, need: int) -> None:
    """One more claim per rule and round, until the need is met or no rule has a candidate."""
    remaining = need - sum(selection.counts())
    if remaining <= 0:
        return
    rules = [i for i, rule in enumerate(selection.rules) if not rule.by_filing_days]
    matching = F.array_compact(F.array(*[F.when(F.col(f"_rule{i}"), F.lit(i)) for i in rules]))
    turns = round_robin_turns(selection.left_over().select("claim_id", F.explode(matching).alias("rule")))
    found = {r["rule"]: r["count"] for r in turns.groupBy("rule").count().collect()}  # one row per rule
    dealt = robin_quotas([found.get(i, 0) for i in rules], remaining)
    last = F.lit(0)
    for i, n in zip(rules, dealt):
        last = F.when(F.col("rule") == i, F.lit(n)).otherwise(last)
    selection.add_rows(turns.where(F.col("turn") <= last))


def fallback_pass(selection: Selection, need: int, code: str = "CO50") -> None:
    """What is still missing comes from the claims no rule took, at random."""
    remaining = need - sum(selection.counts())
    if remaining > 0:
        cut = find_cut(selection.left_over(), remaining, "_draw", "claim_id")
        index = [r.code for r in selection.rules].index(code)
        selection.add(index, cut.takes(F.col("_draw"), F.col("claim_id")), fallback=True)


def select_claims(pool: DataFrame, rules: Sequence[RuleSpec], need: int) -> Selection:
    """All four passes."""
    selection = Selection(rule_flags(pool, rules), rules)
    quota = math.ceil(need / len(selection.rules))
    priority_pass(selection, quota)
    shortage_pass(selection, quota, need)
    round_robin_pass(selection, need)
    fallback_pass(selection, need)
    return selection


def check_evidence(selected: DataFrame) -> None:
    """Fail if a selected claim has no evidence."""
    bad = selected.where(F.col("evidence").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"missing evidence for category {bad[0]['category']}")


def apply_denials(claims: DataFrame, selected_ids: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Selected claims become Denied with nothing paid."""
    marked = lookup_join(
        claims,
        selected_ids.select("claim_id", F.lit(True).alias("_new")),
        "claim_id",
        spread_by=["encounter_id", "patient_id", "billed_amount"],
        hot=hot_keys_by_column(claims, ["claim_id"], hot_rows)["claim_id"],
    )
    return marked.withColumns(
        {
            "claim_status": F.when(F.col("_new"), "Denied").otherwise(F.col("claim_status")),
            "paid_amount": F.when(F.col("_new"), F.lit(0.0)).otherwise(F.col("paid_amount")),
        }
    ).drop("_new")


def new_denials(selected: DataFrame, denials: DataFrame, seed: int = 42) -> DataFrame:
    """Denial rows for the selected claims, numbered on from the largest existing id."""
    last = max_numeric_suffix(denials, "denial_id").collect()[0]["max_number"]
    used = selected.select(  # the ranked rows are sorted and written, so only what a denial is made of
        "claim_id", "category_no", "category", "reason_text", "profile", "billed_amount", "claim_billing_dt", "visit_dt"
    )
    numbered = global_rank(used, [F.col("category_no"), F.col("claim_id")], "number")
    key = F.col("claim_id")
    day = denial_date(base_date(F.col("claim_billing_dt"), F.col("visit_dt")), F.col("category"), key, seed)
    return (
        numbered.withColumn("_day", day)
        .withColumn("_appeal", appeal(F.col("profile"), F.col("_day"), key, seed))
        .select(
            "claim_id",
            denial_id(F.lit(last) + F.col("number")).alias("denial_id"),
            F.col("category").alias("denial_reason_code"),
            F.col("reason_text").alias("denial_reason_description"),
            F.col("billed_amount").alias("denied_amount"),
            format_date(F.col("_day")).alias("denial_date"),
            F.col("_appeal.appeal_filed").alias("appeal_filed"),
            F.col("_appeal.appeal_status").alias("appeal_status"),
            format_date(F.col("_appeal.appeal_resolution_date")).alias("appeal_resolution_date"),
            F.col("_appeal.final_outcome").alias("final_outcome"),
        )
    )


@dataclass(frozen=True)
class Augmented:
    claims: DataFrame
    denials: DataFrame
    selected: DataFrame
    summary: DataFrame
    category_counts: DataFrame
    samples: DataFrame


def augment(
    tables: ClaimTables,
    ratio: float = TARGET_RATIO,
    words: Sequence[str] = NON_COVERED_WORDS,
    departments: Sequence[str] = WATCHED_DEPARTMENTS,
    z_prefix: str = "Z",
) -> Augmented:
    """The whole augmentation. When the target is met already, claims and denials come back as they are."""
    sizes = _sizes(tables.claims, 9, ratio)
    if sizes.need == 0:
        nothing = tables.claims.where(F.lit(False))
        texts = {c: F.lit("") for c in ("category", "reason_text", "profile", "evidence")}
        selected = nothing.withColumns({"category_no": F.lit(0), **texts})
        claims, denials = tables.claims, tables.denials
    else:
        pool = candidate_pool(claim_features(tables, z_prefix))
        selection = select_claims(pool, pool_rules(pool, words, departments), sizes.need)
        selected = materialize(selection.rows(pool), "selection")
        check_evidence(selected)
        claims = apply_denials(tables.claims, selected)
        denials = tables.denials.unionByName(new_denials(selected, tables.denials), allowMissingColumns=True)
    return Augmented(
        claims=claims,
        denials=denials,
        selected=selected,
        summary=augmentation_summary(tables.claims, selected, ratio),
        category_counts=category_counts(selected),
        samples=selection_samples(selected),
    )


def augmentation_summary(claims: DataFrame, selected: DataFrame, ratio: float = TARGET_RATIO) -> DataFrame:
    """One row of totals."""
    added = selected.agg(F.count(F.lit(1)).alias("new_denials_added"))  # one row
    return (
        target_sizes(claims, 9, ratio)
        .crossJoin(added)
        .select(
            "total_claims",
            "current_denied",
            "target_denied",
            "new_denials_added",
            (F.col("current_denied") + F.col("new_denials_added")).alias("final_denied"),
        )
    )


def category_counts(selected: DataFrame) -> DataFrame:
    """New denials per category."""
    return selected.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def selection_samples(selected: DataFrame, n: int = 20) -> DataFrame:
    """The first n selected claims in category order."""
    return (
        selected.orderBy("category_no", "claim_id")
        .limit(n)
        .select("category_no", "claim_id", "category", "evidence", "billed_amount")
    )


def prefers_timely(days: Column) -> Column:
    """True for delays at or over the filing limit."""
    return F.coalesce(days >= TIMELY_DAYS, F.lit(False))
