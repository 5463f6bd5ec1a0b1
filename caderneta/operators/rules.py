"""Rules: patterns on the cleaned text with optional conditions; the first rule that matches wins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caderneta.functions import fields
from caderneta.functions.prompts import CATEGORIES
from caderneta.operators import patterns
from caderneta.operators.ordered import RunningSum, row_number, scan
from caderneta.session import materialise

REGEX, LITERAL = "regex", "literal"
# Patterns that are broadcast together, what a row of the table takes besides its pattern, and priorities that are summed up together.
BLOCK_BYTES = 8 << 20
ROW_BYTES = 200
RULES_PER_CHUNK = 4096


@dataclass(frozen=True)
class Rule:
    """``literal`` patterns match as lower-case substrings, any of them is enough."""

    name: str
    kind: str
    patterns: Sequence[str]
    category: str
    confidence: float
    amount_range: tuple[float, float] | None = None
    holder: str | None = None
    origin: str | None = None
    installments: int | None = None


def _category(beginning: str) -> str:
    """The one category that begins so."""
    (found,) = [c for c in CATEGORIES if c.startswith(beginning)]
    return found


_SUBSCRIPTIONS = _category("Gastos com mensalidades")
_TRANSPORT = _category("Combustível")
_FOOD = _category("Restaurantes")
_TRAVEL = _category("Viagens")
_EDUCATION = _category("Gastos com Educação")
_CARE = _category("Cuidados Pessoais")

# The default rules, in order of priority.
DEFAULT_RULES = (
    Rule("netflix", REGEX, ("netflix",), _SUBSCRIPTIONS, 0.95),
    Rule("spotify", REGEX, ("spotify",), _SUBSCRIPTIONS, 0.95),
    Rule("disney_plus", REGEX, ("disney.*plus",), _SUBSCRIPTIONS, 0.95),
    Rule("prime_video", REGEX, ("prime.*video|amazon.*prime",), _SUBSCRIPTIONS, 0.95),
    Rule("uber", LITERAL, ("uber", "99.*app"), _TRANSPORT, 0.90),
    Rule("gasolina_posto", LITERAL, ("posto", "shell", "ipiranga", "petrobras", "br distribuidora"), _TRANSPORT, 0.85),
    Rule("supermercado_carrefour", REGEX, ("carrefour",), "Supermercado", 0.90),
    Rule("supermercado_extra", REGEX, ("extra",), "Supermercado", 0.90),
    Rule("supermercado_walmart", REGEX, ("walmart",), "Supermercado", 0.90),
    Rule("supermercado_atacadao", REGEX, ("atacad[aã]o",), "Supermercado", 0.90),
    Rule("farmacia_drogasil", REGEX, ("drogasil",), "Farmácia", 0.90),
    Rule("farmacia_pague_menos", REGEX, ("pague.*menos",), "Farmácia", 0.90),
    Rule("farmacia_raia", REGEX, ("raia",), "Farmácia", 0.90),
    Rule("restaurante_ifood", REGEX, ("ifood",), _FOOD, 0.90),
    Rule("restaurante_rappi", REGEX, ("rappi",), _FOOD, 0.90),
    Rule("restaurante_uber_eats", REGEX, ("uber.*eats",), _FOOD, 0.90),
    Rule("viagem_booking", REGEX, ("booking",), _TRAVEL, 0.90),
    Rule("viagem_airbnb", REGEX, ("airbnb",), _TRAVEL, 0.90),
    Rule("viagem_decolar", REGEX, ("decolar",), _TRAVEL, 0.90),
    Rule("educacao_cultura_inglesa", REGEX, ("cultura.*inglesa",), _EDUCATION, 0.90),
    Rule("educacao_kumon", REGEX, ("kumon",), _EDUCATION, 0.90),
    Rule("saude_nutricionista", REGEX, ("nutricionista",), _CARE, 0.85),
    Rule("saude_medico", REGEX, ("medico|médico|clínica|hospital",), _CARE, 0.85),
    Rule("conta_luz", REGEX, ("conta.*luz|energia.*elétrica|cemig|light|enel",), "Conta de luz", 0.95),
    Rule("conta_gas", REGEX, ("conta.*g[aá]s|g[aá]s.*natural",), "Conta de gás", 0.95),
    Rule(
        "internet_tv", REGEX, ("internet|tv.*cabo|net.*virtua|oi.*fibra|vivo.*fibra",), "Internet & TV a cabo", 0.90
    ),
)

RULE_SCHEMA = (
    "priority int, name string, kind string, pattern string, category string, confidence double, "
    "amount_min double, amount_max double, holder string, origin string, installments int"
)


def admit(rules: Sequence[Rule], new: Rule, categories: Sequence[str] = CATEGORIES) -> tuple[Rule, ...]:
    """The rule list with ``new`` at the end; unknown categories are refused."""
    if not (new.name and new.patterns and new.category) or new.confidence is None:
        raise ValueError("a rule needs name, pattern, category and confidence")
    if new.category not in categories:
        raise ValueError(f"unknown category: {new.category}")
    return (*rules, new)


def without(rules: Sequence[Rule], name: str) -> tuple[Rule, ...]:
    return tuple(r for r in rules if r.name != name)


def _pattern_match(rule: Rule, text: Column) -> Column:
    tests = [
        F.rlike(text, F.lit(f"(?iu){p}")) if rule.kind == REGEX else F.contains(text, F.lit(p.lower()))
        for p in rule.patterns
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _conditions(rule: Rule, has: Sequence[str]) -> Column | None:
    """Conditions are AND-ed; a row without holder or origin passes those two."""
    out: Column | None = None

    def both(c: Column) -> Column:
        return c if out is None else out & c

    if rule.amount_range is not None:
        out = both(F.col("amount").between(*rule.amount_range))
    for name in ("holder", "origin"):
        wanted = getattr(rule, name)
        if wanted is not None and name in has:
            held = F.contains(F.lower(F.col(name)), F.lit(wanted.lower()))
            out = both(F.coalesce(F.col(name), F.lit("")).eqNullSafe(F.lit("")) | held)
    if rule.installments is not None:
        out = both(F.coalesce(F.col("installments") == rule.installments, F.lit(False)))
    return out


def first_rule(rules: Sequence[Rule], text: Column, has: Sequence[str] = (), named: bool = True) -> Column:
    """struct(label, confidence[, rule]) of the first match, null without one.

    One CASE expression: evaluated per row until a branch matches, no join and no shuffle.
    ``has`` names the condition columns of the frame (``holder``, ``origin``).
    """
    chain = None
    for rule in rules:
        hit, extra = _pattern_match(rule, text), _conditions(rule, has)
        hit = hit if extra is None else hit & extra
        parts = [F.lit(rule.category).alias("label"), F.lit(float(rule.confidence)).alias("confidence")]
        value = F.struct(*parts, *([F.lit(rule.name).alias("rule")] if named else []))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    if chain is None:
        return F.lit(None).cast(f"struct<label:string,confidence:double{',rule:string' if named else ''}>")
    return chain


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Long form: one row per pattern."""
    rows = [
        (i, r.name, r.kind, p, r.category, float(r.confidence), *(map(float, r.amount_range) if r.amount_range else (None, None)), r.holder, r.origin, r.installments)
        for i, r in enumerate(rules)
        for p in r.patterns
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def admissible(rules: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rules, refused rules): nothing required may be null and the category must be known."""
    complete = (
        F.col("name").isNotNull() & F.col("pattern").isNotNull()
        & F.col("category").isNotNull() & F.col("confidence").isNotNull()
    )
    known = rules.join(categories.select("category"), "category", "left_semi").select(*rules.columns)
    unknown = rules.join(categories.select("category"), "category", "left_anti").select(*rules.columns)
    return known.filter(complete), unknown.unionByName(known.filter(~complete))


def _row_conditions(rule: Column, has: Sequence[str]) -> Column:
    """The conditions of ``_conditions`` for a rule that is a struct of the row."""
    low, high = rule["amount_min"], rule["amount_max"]
    out = low.isNull() & high.isNull()
    if "amount" in has:
        amount = F.col("amount").cast("double")
        within = (low.isNull() | (amount >= low)) & (high.isNull() | (amount <= high))
        out = out | F.coalesce(within, F.lit(False))
    for name in ("holder", "origin"):
        if name in has:
            held = F.contains(F.lower(F.col(name)), F.lower(rule[name]))
            out = out & (rule[name].isNull() | (F.coalesce(F.col(name), F.lit("")) == "") | held)
    installments = rule["installments"].isNull()
    if "installments" in has:
        installments = installments | F.coalesce(F.col("installments") == rule["installments"], F.lit(False))
    return out & installments


def _up_to_free(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rules ``c`` up to the first one without conditions of each key: that one always holds, so none behind it can win."""
    free = F.min(F.when(F.col("c.__free"), F.col("c"))).over(W.partitionBy(*keys))
    return rules.withColumn("__free", free).filter(F.col("__free").isNull() | (F.col("c") <= F.col("__free"))).drop("__free")


def match_rule_table(
    df: DataFrame, rules: DataFrame, text: str, has: Sequence[str] = (), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``df`` with ``rule`` = struct(label, confidence, rule), from a rule table of any size.

    ``has`` names the condition columns of ``df`` (``amount``, ``holder``, ``origin``, ``installments``). As for compiled rules, a
    missing or empty holder or origin passes; a rule on amounts or installments needs these columns. A rule without
    priority comes last.

    Rules that share a pattern are reduced first: of equal conditions the first rule stays, and none behind the pattern's first rule
    without conditions, as they can never win. Distinct patterns meet the distinct texts in blocks of at most ``block_bytes`` of patterns in the
    order of their first rules, so what is sent out has a fixed size; rules never pass through the driver. One automaton over the literals that a
    block's patterns require scans each text once (``patterns``); only the pairs that it finds are tested in full. A text leaves once a rule
    without conditions has matched it that comes before all later patterns. Conditions are tested on the rows, against the rules up to the first
    one without conditions that matches their text.
    """
    table = rules.select(*[f.split()[0] for f in RULE_SCHEMA.split(", ")]).filter("pattern is not null")
    table = table.withColumns({
        "kind": F.when(F.col("kind") == REGEX, REGEX).otherwise(LITERAL),
        "__rank": F.coalesce("priority", F.lit(2**31 - 1)).cast("bigint"),
        "__free": F.coalesce("amount_min", "amount_max", F.col("installments").cast("double")).isNull() & F.coalesce("holder", "origin").isNull(),
    })
    conditions = ["amount_min", "amount_max", "holder", "origin", "installments"]
    candidate = F.struct("__rank", "name", F.col("category").alias("label"), "confidence", "__free", *conditions)
    firsts = table.groupBy("kind", "pattern", *conditions).agg(F.min(candidate).alias("c")).select("kind", "pattern", "c")
    firsts = materialise(_up_to_free(firsts, ["kind", "pattern"]), "rules")
    distinct = firsts.groupBy("kind", "pattern").agg(F.min("c").alias("__first")).withColumn("__rank", F.col("__first.__rank"))
    sized = scan(
        distinct, [], ["__rank", "__first", "kind", "pattern"], F.floor(F.col("__rank") / RULES_PER_CHUNK),
        [RunningSum("__bytes", F.octet_length("pattern").cast("bigint") + ROW_BYTES), row_number("__id")],
    )
    blocks = sized.select("kind", "pattern", "__rank", "__id", F.floor(F.col("__bytes") / block_bytes).alias("__block"))
    blocks = materialise(blocks, "rule-patterns")
    open_texts = df.select(F.col(text).alias("__text")).filter(F.col("__text").isNotNull()).distinct()
    matched = None
    numbers = blocks.groupBy("__block").agg(F.max("__rank").alias("last")).orderBy("__block").collect()
    for k, (number, last) in enumerate(numbers):
        if len(numbers) > 1:
            open_texts = materialise(open_texts, "rule-texts")
        hit = F.when(
            F.col("kind") == REGEX, F.expr("__text rlike concat('(?iu)', pattern)")
        ).otherwise(F.contains(F.col("__text"), F.lower(F.col("pattern"))))
        part = blocks.filter(F.col("__block") == number).select("__id", "kind", "pattern")
        # A block of bounded size, as a list for the automaton.
        listed = [(r["__id"], r["pattern"] if r["kind"] == REGEX else r["pattern"].lower(), r["kind"] == REGEX) for r in part.collect()]
        pairs = open_texts.select("__text", F.explode(patterns.candidates(F.col("__text"), listed)).alias("__id"))
        hits = pairs.join(F.broadcast(part), "__id").filter(hit).select("__text", "kind", "pattern")
        found = hits.join(firsts, ["kind", "pattern"]).select("__text", "c")
        if k < len(numbers) - 1:
            found = materialise(found, "rule-hits")
            done = found.filter(F.col("c.__free") & (F.col("c.__rank") < last)).select("__text").distinct()
            open_texts = open_texts.join(done, "__text", "left_anti")
        matched = found if matched is None else matched.unionByName(found)
    if matched is None:
        return df.withColumn("rule", F.lit(None).cast("struct<label:string,confidence:double,rule:string>"))
    per_text = _up_to_free(matched, ["__text"]).groupBy("__text").agg(F.array_sort(F.collect_set("c")).alias("__rules"))
    fitting = F.try_element_at(F.filter("__rules", lambda r: _row_conditions(r, has)), F.lit(1))
    chosen = F.when(fitting.isNotNull(), F.struct(fitting["label"].alias("label"), fitting["confidence"].alias("confidence"), fitting["name"].alias("rule")))
    joined = df.join(per_text, F.col(text) == F.col("__text"), "left")
    return joined.withColumn("rule", chosen).drop("__text", "__rules")


def rule_stats(rules: DataFrame) -> DataFrame:
    """Rules per category and their mean confidence; the null category is the grand total."""
    per_rule = rules.groupBy("priority").agg(F.first("category").alias("category"), F.first("confidence").alias("confidence"))
    per = per_rule.groupBy("category").agg(F.count("*").alias("rules"), F.avg("confidence").alias("mean_confidence"))
    total = per_rule.agg(F.count("*").alias("rules"), F.avg("confidence").alias("mean_confidence"))
    return per.unionByName(total.withColumn("category", F.lit(None).cast("string")))


def card_stage(card: Column) -> Column:
    """Kind and sharing of a card label, as the older cascade put them in front of the patterns."""
    kind, share = fields.card_type(card), fields.card_share(card)
    return F.coalesce(kind, share)


def holder_stage(card: Column, holders: fields.HolderRules = fields.HolderRules()) -> Column:
    share = fields.adjusted_share(F.lit(""), card, holders)
    known = fields.holder_of(card, holders).isNotNull() & (share != "")
    return F.when(known, F.struct(share.alias("label"), F.lit(0.85).alias("confidence")))


def rules_stage(
    text: Column, card: Column | None = None, rules: Sequence[Rule] = DEFAULT_RULES,
    holders: fields.HolderRules = fields.HolderRules(), card_as_category: bool = False, has: Sequence[str] = (),
) -> Column:
    """struct(label, confidence): card rules, then holder rules, then patterns.

    Card and holder rules yield a card type or a sharing label, not a category. They only take
    part with ``card_as_category``, which reproduces the older mixed column.
    """
    pattern = first_rule(rules, text, has, named=False)
    if not card_as_category or card is None:
        return pattern
    return F.coalesce(card_stage(card), holder_stage(card, holders), pattern)
