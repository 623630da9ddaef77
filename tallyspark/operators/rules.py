"""Rules: name patterns, checks of rows, and user rules folded over columns.

Conditions and actions are functions from columns to columns, so a rule set becomes one projection in Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import automaton
from ..sources.tables import saved

#: Pack sizes that names give in brackets (units may be picked), and as a fraction (cases only).
BRACKETS, FRACTIONS = (6, 8, 9, 10, 12, 18, 24), (6, 8, 9, 10, 12, 24, 30)
#: Name patterns of the versioned rule set, and its limits.
CASE_PATTERNS = ("1/8", "1/12", "1/20", "1/24")
UNIT_PATTERNS = ("(6)", "(8)", "(9)", "(12)", "(18)", "(24)")
QUANTITY_RANGE, CONFIDENCE = (0, 9999), 70


def name_rules(spark: SparkSession) -> DataFrame:
    """The declarative rules on names; a lower priority comes first."""
    rows = [(f"R{i:03d}", 100, "contains", f"({n})", n, True) for i, n in enumerate(BRACKETS, 1)]
    rows += [(f"R{i:03d}", 90, "contains", f"1/{n}", n, False) for i, n in enumerate(FRACTIONS, len(BRACKETS) + 1)]
    return spark.createDataFrame(rows, schemas.NAME_RULE)


def match_names(products: DataFrame, rules: list, name: str = "name") -> DataFrame:
    """``products`` with the id, pack size and allowUnits of the first rule by priority, then id, whose type and value match the name.

    ``rules`` are rows of a rule list, a configuration. A short one becomes one CASE expression; of a long one the words and brands are
    looked for by an automaton, so that neither plan nor work for a name grows with their number.
    """
    ordered = sorted(rules, key=lambda r: (r["priority"], r["id"]))
    if len(ordered) > automaton.PLAIN:
        return _many_matched(products, ordered, name)
    out = [None, None, None]
    for rule in reversed(ordered):
        text = F.col(name)
        hit = {"contains": lambda v: F.contains(text, F.lit(v)), "regex": lambda v: text.rlike(v), "brand": lambda v: F.lower(text).startswith(v.lower())}[rule["type"]](rule["value"])
        out = [F.when(hit, F.lit(rule[c])).otherwise(o if o is not None else F.lit(None)) for c, o in zip(("id", "packSize", "allowUnits"), out, strict=True)]
    kinds = ("string", "int", "boolean")
    return products.withColumns({c: (o if o is not None else F.lit(None)).cast(k) for c, o, k in zip(("rule_id", "rule_pack_size", "rule_allows"), out, kinds, strict=True)})


def _many_matched(products: DataFrame, ordered: list, name: str) -> DataFrame:
    """``match_names`` of a long list in order of priority: each kind gives the place of its first rule, the least place counts, and a table of places tells its rule."""
    of = lambda kind: [(i, r["value"]) for i, r in enumerate(ordered) if r["type"] == kind]
    words, brands, patterns = of("contains"), of("brand"), of("regex")
    places = []
    if words:
        places.append(_placed_word(F.col(name), words))
    if brands:  # what a name begins with: a mark before both lets the automaton find it at the start only
        places.append(_placed_word(F.concat(F.lit(START), F.lower(name)), [(i, START + v.lower()) for i, v in brands]))
    for i, pattern in patterns:
        places.append(F.when(F.col(name).rlike(pattern), F.lit(i)))
    place = F.least(*places) if len(places) > 1 else places[0]
    table = products.sparkSession.createDataFrame([(i, r["id"], r["packSize"], r["allowUnits"]) for i, r in enumerate(ordered)], "_place int, rule_id string, rule_pack_size int, rule_allows boolean")
    return products.drop("rule_id", "rule_pack_size", "rule_allows").withColumn("_place", place).join(F.broadcast(table), "_place", "left").drop("_place")  # the configuration


#: Stands before a name whose beginning is asked for; names don't hold it.
START = "\ue000"


def _placed_word(text: Column, words: list[tuple[int, str]]) -> Column:
    """The place among all rules of the first of ``words`` (place, word) that a text contains."""
    return automaton.first_word(text, [w for _, w in words], [i for i, _ in words])


def contains_any(x: Column, values: tuple[str, ...]) -> Column:
    return automaton.contains_any(x, values)


def pattern_checks(name: Column, unit: Column, case_only: Column, catalog_first: bool = True) -> Column:
    """(rule, status) of the two name rules: a fraction makes a product case-only, a count in brackets lets units be picked; the catalog's word goes first if it is to."""
    fraction, bracket = contains_any(name, CASE_PATTERNS), contains_any(name, UNIT_PATTERNS)
    says = case_only.isNotNull() if catalog_first else F.lit(False)
    case_fails = F.when(says, F.coalesce(case_only, F.lit(False))).otherwise(fraction) & (unit == "unit")
    return F.array(F.struct(F.lit("R008").alias("rule"), F.when(case_fails, "fail").otherwise("pass").alias("status")), F.struct(F.lit("R009").alias("rule"), F.when(bracket & ~fraction & (unit == "case"), "warn").otherwise("pass").alias("status")))


def unit_type(name: Column, case_only: Column, catalog_first: bool = True) -> Column:
    """'case' or 'unit': what the catalog says, a fraction in the name, a count in brackets, else case; the catalog comes last if it doesn't come first."""
    catalog = F.when(case_only.isNotNull(), F.when(case_only, "case").otherwise("unit"))
    heuristic = F.when(name.rlike(r"1/[0-9]+"), "case").when(name.rlike(r"\([0-9]+\)"), "unit")
    return F.coalesce(*((catalog, heuristic) if catalog_first else (heuristic, catalog)), F.lit("case"))


def row_checks(rows: DataFrame, threshold: int = CONFIDENCE, limits: tuple[int, int] = QUANTITY_RANGE) -> DataFrame:
    """``rows`` with ``results``, (rule, status) of every row rule, and ``gate``: 'queue' if any failed, 'review' if any warns, else 'proceed'.

    The unit is judged as parsed; confidence is between 0 and 1.
    """
    twice = F.count(F.lit(1)).over(Window.partitionBy("job_id", "page", "product_key", "unit")) > 1
    status = lambda bad, kind: F.when(F.coalesce(bad, F.lit(False)), kind).otherwise("pass")
    unit = F.col("unit") == "unit"
    odd = F.col("allow_unit_picking") & (F.col("unit") == "case") & F.col("name").rlike(r"\([0-9]+\)")
    checks = {
        "R001": F.when(F.coalesce(unit & (F.col("case_only") | F.col("name").rlike("1/[0-9]+")), F.lit(False)), "fail").when(F.coalesce(odd, F.lit(False)), "warn").otherwise("pass"),
        "R002": status(~F.col("quantity").between(*limits) | F.col("quantity").isNull(), "fail"),
        "R003": status(F.col("resolved_by").isNull(), "fail"),
        "R004": status(F.col("confidence") * 100 < threshold, "warn"),
        "R005": status(twice & F.col("product_key").isNotNull(), "warn"),
    }
    results = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("status")) for k, v in checks.items()])
    has = lambda kind: F.exists("results", lambda r: r["status"] == kind)
    return rows.withColumn("results", results).withColumn("gate", F.when(has("fail"), "queue").when(has("warn"), "review").otherwise("proceed"))


#: Kinds of configured rules on rows, and of those on totals, which ``total_checks`` runs.
ROW_KINDS = ("UNIT_TYPE_ENFORCEMENT", "QUANTITY_RANGE", "PRODUCT_RESOLVED", "CONFIDENCE_THRESHOLD", "DUPLICATE_DETECTION", "CASE_ONLY_NAME_PATTERN", "UNIT_PICKING_NAME_PATTERN")
TOTAL_KINDS = ("ZERO_TOTAL", "UNUSUALLY_HIGH_QUANTITY")
#: Says that the catalog's flags go before the name patterns; it is no check of its own.
OVERRIDES = "CATALOG_OVERRIDES_HEURISTICS"
RULE_ERROR = "RULE_ERROR"


def _row_kind(kind: str, params: dict, catalog_first: bool) -> Column | None:
    """Whether a row breaks a configured rule; null where that can't be told. None for a kind that isn't a row's."""
    name, unit, limit = F.col("name"), F.col("unit"), params.get
    says = F.col("case_only").isNotNull() & F.lit(catalog_first)
    if kind == "UNIT_TYPE_ENFORCEMENT":
        return F.coalesce((unit == "unit") & (F.col("case_only") | name.rlike("1/[0-9]+")), F.lit(False))
    if kind == "QUANTITY_RANGE":
        return ~F.col("quantity").between(limit("min"), limit("max"))
    if kind == "PRODUCT_RESOLVED":
        return F.col("resolved_by").isNull()
    if kind == "CONFIDENCE_THRESHOLD":
        return F.col("confidence") * 100 < limit("threshold")
    if kind == "DUPLICATE_DETECTION":
        return (F.count(F.lit(1)).over(Window.partitionBy("job_id", "page", "product_key", "unit")) > 1) & F.col("product_key").isNotNull()
    if kind == "CASE_ONLY_NAME_PATTERN":
        return F.when(says, F.col("case_only")).otherwise(contains_any(name, tuple(limit("patterns") or ()))) & (unit == "unit")
    if kind == "UNIT_PICKING_NAME_PATTERN":
        return F.when(says, F.lit(False)).otherwise(contains_any(name, tuple(limit("patterns") or ()))) & (unit == "case")
    return None


def compiled(entries: list[dict]) -> tuple[list[tuple[str, str, Column]], list[str]]:
    """((id, severity, whether a row breaks it) of each enabled rule of a rule catalog that is for rows, warnings).

    ``entries`` are a short configuration, with the fields of ``schemas.RULE``. Rules of totals are left to
    ``total_checks``. An unsupported kind is left out with a warning. A rule that can't be built, such as one without
    its limits, is broken by every row, and so is one whose outcome for a row is null: RULE_ERROR.
    """
    live = [e for e in entries if e["enabled"]]
    catalog_first = any(e["ruleType"] == OVERRIDES for e in live)
    found, warnings = [], []
    for e in live:
        kind = e["ruleType"]
        if kind not in ROW_KINDS:
            if kind not in (*TOTAL_KINDS, OVERRIDES):
                warnings.append(f"{e['id']}: unsupported rule type {kind}")
            continue
        try:
            found.append((e["id"], e["severity"], _row_kind(kind, e.get("params") or {}, catalog_first)))
        except Exception as error:  # a rule's own failure must not end the job
            warnings.append(f"{e['id']}: {error}")
            found.append((e["id"], e["severity"], F.lit(None).cast("boolean")))
    return found, warnings


def configured_checks(rows: DataFrame, entries: list[dict]) -> DataFrame:
    """``rows`` with ``results``, (rule, status, code) of every enabled rule of the catalog in its order, and ``gate``, as ``row_checks`` has them.

    A broken rule gives its severity as status; one that can't be told fails with RULE_ERROR.
    """
    made, _ = compiled(entries)
    one = lambda name, severity, bad: F.struct(F.lit(name).alias("rule"), F.when(bad.isNull(), "fail").when(bad, severity).otherwise("pass").alias("status"), F.when(bad.isNull(), RULE_ERROR).alias("code"))
    results = F.array(*[one(*m) for m in made]) if made else F.array().cast("array<struct<rule:string,status:string,code:string>>")
    has = lambda kind: F.exists("results", lambda r: r["status"] == kind)
    return rows.withColumn("results", results).withColumn("gate", F.when(has("fail"), "queue").when(has("warn"), "review").otherwise("proceed"))


def keyed_results(rows: DataFrame) -> DataFrame:
    """(job_id, page, row, rule, status, code), a row for each result; of rows that share a key each keeps its results."""
    flat = rows.select("job_id", "page", "row", F.explode("results").alias("r"))
    return flat.select("job_id", "page", "row", "r.*")


def total_checks(totals: DataFrame, entries: list[dict]) -> DataFrame:
    """Totals that an enabled rule of totals names, with the rule and its severity; a rule of high quantities without a threshold names none."""
    out = None
    for e in entries:
        if not e["enabled"] or e["ruleType"] not in TOTAL_KINDS:
            continue
        limit = (e.get("params") or {}).get("threshold")
        bad = (F.col("cases") == 0) & (F.col("units") == 0) if e["ruleType"] == "ZERO_TOTAL" else F.lit(False) if limit is None else (F.col("cases") > limit) | (F.col("units") > limit)
        some = totals.where(bad).withColumns({"rule": F.lit(e["id"]), "status": F.lit(e["severity"])})
        out = some if out is None else out.unionByName(some)
    return totals.withColumns({"rule": F.lit(""), "status": F.lit("")}).limit(0) if out is None else out


#: Conditions and actions get a row's columns by name from the function that they are given, so that it is known what they read.
Condition = Callable[[Callable[[str], Column], dict], Column]
Action = Callable[[Callable[[str], Column], dict], "dict[str, Column | Appended]"]


@dataclass
class Rule:
    """A configured rule: names of a registered condition and action with their parameters."""

    id: str
    condition: str
    condition_params: dict
    action: str
    action_params: dict
    priority: int = 100
    enabled: bool = True


@dataclass
class RuleEngine:
    """Registered conditions and actions, and rules by id."""

    conditions: dict[str, Condition] = field(default_factory=dict)
    actions: dict[str, Action] = field(default_factory=dict)
    rules: dict[str, Rule] = field(default_factory=dict)

    @staticmethod
    def standard() -> RuleEngine:
        of = lambda row, p: row(p["field"])
        return RuleEngine(
            {
                "contains": lambda row, p: F.contains(of(row, p), F.lit(p["value"])),
                "regex": lambda row, p: of(row, p).rlike(p["value"]),
                "brand": lambda row, p: F.lower(of(row, p)).startswith(p["value"].lower()),
                "equals": lambda row, p: of(row, p) == F.lit(p["value"]),
                "range": lambda row, p: of(row, p).between(p["min"], p["max"]),
                "missing": lambda row, p: F.coalesce(of(row, p).cast("string"), F.lit("")) == "",
            },
            {
                "set_unit": lambda row, p: {"unit": F.lit(p["value"])},
                "set_quantity": lambda row, p: {"quantity": F.lit(p["value"]).cast("decimal(18,3)")},
                "warn": lambda row, p: {"warnings": Appended(F.array(F.lit(p["message"])))},
            },
        )

    def add(self, rule: Rule) -> None:
        self.rules[rule.id] = rule

    def remove(self, rule_id: str) -> bool:
        return self.rules.pop(rule_id, None) is not None

    def get(self, rule_id: str) -> Rule | None:
        return self.rules.get(rule_id)

    def all(self) -> tuple[Rule, ...]:
        """All rules as added, disabled ones too."""
        return tuple(self.rules.values())

    def enable(self, rule_id: str, on: bool = True) -> None:
        self.rules[rule_id].enabled = on

    def kinds(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Names of the registered conditions and actions."""
        return tuple(self.conditions), tuple(self.actions)

    def load(self, configs: list[dict]) -> None:
        """Adds the enabled rules of a configuration: id, enabled, priority, conditionType, conditionParams, actionType and actionParams."""
        for c in configs:
            if c["enabled"]:
                self.add(Rule(c["id"], c["conditionType"], c.get("conditionParams") or {}, c["actionType"], c.get("actionParams") or {}, c["priority"]))

    def list(self) -> list[Rule]:
        """Enabled rules, lowest priority first, then as added."""
        return sorted((r for r in self.rules.values() if r.enabled), key=lambda r: r.priority)

    def run(self, rows: DataFrame) -> DataFrame:
        """``rows`` after all rules in turn, each seeing what those before it changed, with ``executed``: (rule, executed, matched) of each.

        A rule of an unregistered kind, or one that can't be built, doesn't run and leaves a warning. A condition that
        is null doesn't match. Rules that don't build on each other are one projection (``levels``); after CUT projections
        a barrier keeps Catalyst from nesting them, and after SAVE of them rows are written, so that plans stay short.
        """
        out = rows if "warnings" in rows.columns else rows.withColumn("warnings", F.array().cast("array<string>"))
        made, hits = [self._made(rule) for rule in self.list()], {}
        for k, level in enumerate(levels(made), 1):
            flag = f"_hits_{k}"
            out = out.withColumn(flag, F.array(*[F.coalesce(made[i].hit, F.lit(False)) for i in level]))
            hits |= {i: F.col(flag)[n] for n, i in enumerate(level)}
            changed: dict[str, Column] = {}
            for column in dict.fromkeys(c for i in level for c in made[i].changes):
                writers = [(hits[i], made[i].changes[column]) for i in level if column in made[i].changes]
                if isinstance(writers[0][1], Appended):
                    parts = [F.when(hit, v.items).otherwise(F.array().cast("array<string>")) for hit, v in writers]
                    changed[column] = F.concat(column, *parts)
                else:  # the last that matches
                    value = F.when(*writers[-1])
                    for hit, v in reversed(writers[:-1]):
                        value = value.when(hit, v)
                    changed[column] = value.otherwise(F.col(column))
            out = out.withColumns(changed) if changed else out
            if k % SAVE == 0:
                out = saved(out, "rules")
            elif k % CUT == 0:
                out = out.select(F.inline(F.array(F.struct(*out.columns))))
        results = [F.struct(F.lit(m.id).alias("rule"), F.lit(m.runs).alias("executed"), (hits[i] if m.runs else F.lit(False)).alias("matched")) for i, m in enumerate(made)]
        out = out.withColumn("executed", F.array(*results) if results else F.array().cast("array<struct<rule:string,executed:boolean,matched:boolean>>"))
        return out.drop(*[c for c in out.columns if c.startswith("_hits_")])

    def _made(self, rule: Rule) -> Made:
        """A rule's condition and changes, with the columns that they read."""
        condition, action = self.conditions.get(rule.condition), self.actions.get(rule.action)
        problem, reads = None if condition and action else "unsupported rule", set()

        def row(column: str) -> Column:
            reads.add(column)
            return F.col(column)

        try:
            if not problem:
                return Made(rule.id, True, condition(row, rule.condition_params), action(row, rule.action_params), reads)
        except Exception as error:  # a rule's own failure must not end the job
            problem = f"{RULE_ERROR} {error!r}"
        return Made(rule.id, False, F.lit(True), {"warnings": Appended(F.array(F.lit(f"{rule.id}: {problem}")))}, set())


@dataclass
class Appended:
    """What an action adds to an array of texts, whatever it holds so far."""

    items: Column


@dataclass
class Made:
    """A rule as columns; one that doesn't run only leaves its warning."""

    id: str
    runs: bool
    hit: Column
    changes: dict[str, Column | Appended]
    reads: set[str]


#: Projections of rules until a barrier, and until rows are written.
CUT, SAVE = 10, 50


def levels(made: list[Made]) -> list[list[int]]:
    """The rules' places in levels that can each be one projection.

    A rule comes after those before it that write what it reads, and with or after those that read or write what it
    writes; in a level all read what the level starts from, and the last of those that write a column counts. Texts that rules only
    add to a column stand together in a level, but not with other changes of that column.
    """
    written: dict[str, int] = {}
    read: dict[str, int] = {}
    kinds: dict[tuple[int, str], bool] = {}
    out: list[list[int]] = []
    for i, rule in enumerate(made):
        at = max([0, *(written.get(c, -1) + 1 for c in rule.reads), *(max(written.get(c, 0), read.get(c, 0)) for c in rule.changes)])
        while any(kinds.get((at, c), kind) != kind for c, kind in ((c, isinstance(v, Appended)) for c, v in rule.changes.items())):
            at += 1
        for c in rule.reads:
            read[c] = max(read.get(c, 0), at)
        for c, v in rule.changes.items():
            written[c] = max(written.get(c, 0), at)
            kinds[at, c] = isinstance(v, Appended)
        out.extend([] for _ in range(at + 1 - len(out)))
        out[at].append(i)
    return out
