import random

import pytest
from pyspark.sql import functions as F

from caderneta.functions import text as T
from caderneta.operators import cascade, patterns, rules
from caderneta.operators.rules import LITERAL, REGEX, Rule


@pytest.fixture(scope="module")
def tx(spark):
    rows = [(1, "netflix com", 10.0, None, None), (2, "uber trip", 20.0, "Ana", "fatura"), (3, "padaria", 5.0, "Bia", "extrato"),
            (4, "99 pop app", 5.0, None, None), (5, "drogasil", 7.0, "CC - conta", None), (6, "padaria", 9.0, None, None), (7, None, 1.0, None, None)]
    return spark.createDataFrame(rows, "id int, descr string, amount double, holder string, origin string")


def test_default_rules(spark, tx):
    df = tx.withColumn("rule", rules.first_rule(rules.DEFAULT_RULES, T.rule_text(F.col("descr"))))
    got = {r["id"]: r["rule"] and r["rule"]["rule"] for r in df.collect()}
    # A pattern in a list is a plain substring, so "99.*app" does not match.
    assert got == {1: "netflix", 2: "uber", 3: None, 4: None, 5: "farmacia_drogasil", 6: None, 7: None}


def test_conditions(tx):
    own = [Rule("a", LITERAL, ("padaria",), "Supermercado", 0.9, amount_range=(8, 10)), Rule("b", REGEX, ("padaria",), "Supermercado", 0.8, holder="bia"),
           Rule("c", REGEX, ("uber",), "Supermercado", 0.8, origin="extrato"), Rule("d", REGEX, ("netflix",), "Supermercado", 0.8, origin="extrato")]
    df = tx.withColumn("rule", rules.first_rule(own, F.col("descr"), has=("holder", "origin")))
    got = {r["id"]: r["rule"] and r["rule"]["rule"] for r in df.collect()}
    assert got == {1: "d", 2: None, 3: "b", 4: None, 5: None, 6: "a", 7: None}


def test_rule_table_equals_compiled_rules(spark, tx):
    table = rules.rule_table(spark, rules.DEFAULT_RULES)
    for block in (1 << 20, 500):
        got = {r["id"]: r["rule"] and r["rule"]["rule"] for r in rules.match_rule_table(tx, table, "descr", (), block).collect()}
        assert got == {1: "netflix", 2: "uber", 3: None, 4: None, 5: "farmacia_drogasil", 6: None, 7: None}


def test_rule_table_conditions(spark, tx):
    own = [Rule("a", LITERAL, ("padaria",), "Supermercado", 0.9, amount_range=(8, 10)), Rule("b", REGEX, ("padaria",), "Supermercado", 0.8, holder="bia"),
           Rule("c", REGEX, ("uber",), "Supermercado", 0.8, origin="extrato"), Rule("d", REGEX, ("netflix", "drog"), "Supermercado", 0.8, origin="extrato"),
           Rule("e", LITERAL, ("pop",), "Supermercado", 0.8, installments=3), Rule("f", LITERAL, ("a",), "Supermercado", 0.7)]
    has = ("amount", "holder", "origin", "installments")
    df = tx.withColumn("installments", F.when(F.col("id") == 4, 3))
    want = df.withColumn("rule", rules.first_rule(own, F.col("descr"), has=("holder", "origin")))
    want = {(r["id"], r["rule"] and r["rule"]["rule"]) for r in want.collect()}
    assert want == {(1, "d"), (2, None), (3, "b"), (4, "e"), (5, "d"), (6, "a"), (7, None)}
    table = rules.rule_table(spark, own)
    late = table.withColumn("priority", F.when(F.col("name") != "f", F.col("priority")))  # without priority: last
    for t, block in ((table, 1 << 20), (table, 300), (late, 300)):
        got = rules.match_rule_table(df, t, "descr", has, block)
        assert {(r["id"], r["rule"] and r["rule"]["rule"]) for r in got.collect()} == want and got.count() == 7
    assert rules.match_rule_table(df, table.limit(0), "descr", has).filter("rule is null").count() == 7


def test_required_literals():
    need = patterns.required_literals
    assert need("disney.*plus") == {"disney"} and need("prime.*video|amazon.*prime") == {"prime", "amazon"} or need("prime.*video|amazon.*prime")
    assert need("atacad[aã]o") == {"atacad"} and need("(?:AB|c)+D?") == {"ab", "c"} and need("x*y?") is None
    assert need("a|b*") is None and need("[[a]]") is None and need(r"\p{L}x") is None and need("(?x) a b") is None and need("(") is None
    assert need("(?:foo){2,3}bar1") == {"bar1"} and need("ſK") == {"sk"}


def test_automaton_finds_what_the_expressions_find(spark):
    """Random patterns and texts: every rule that a text matches, against rlike and contains on all pairs."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcAÉé ") for _ in range(rng.randrange(1, 4)))
    forms = [lambda: word(), lambda: f"{word()}.*{word()}", lambda: f"{word()}|{word()}", lambda: f"({word()})?[ab]+{word()}", lambda: f"^{word()}$", lambda: "[ab]{2}"]
    own = [Rule(f"r{i}", REGEX if i % 3 else LITERAL, (rng.choice(forms)() if i % 3 else word(),), "Supermercado", 0.5) for i in range(60)]
    texts = ["".join(rng.choice("abcABCÉé KſI") for _ in range(rng.randrange(12))) for _ in range(150)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    want = {r["id"]: r["rule"] and r["rule"]["rule"] for r in df.withColumn("rule", rules.first_rule(own, F.col("t"))).collect()}
    for block in (1 << 20, 2000):
        out = rules.match_rule_table(df, rules.rule_table(spark, own), "t", (), block)
        assert {r["id"]: r["rule"] and r["rule"]["rule"] for r in out.collect()} == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_rule_admission(spark):
    with pytest.raises(ValueError):
        rules.admit(rules.DEFAULT_RULES, Rule("x", REGEX, ("x",), "no such", 0.5))
    more = rules.admit(rules.DEFAULT_RULES, Rule("x", REGEX, ("x",), "Farmácia", 0.5))
    assert len(rules.without(more, "x")) == len(rules.DEFAULT_RULES)
    table = rules.rule_table(spark, more)
    categories = spark.createDataFrame([("Farmácia",)], "category string")
    good, bad = rules.admissible(table, categories)
    assert good.count() == 4 and good.count() + bad.count() == table.count()
    stats = {r["category"]: r["rules"] for r in rules.rule_stats(table).collect()}
    assert stats[None] == len(more) and stats["Farmácia"] == 4


def test_card_rules_only_on_request(tx):
    text = T.rule_text(F.col("descr"))
    plain = tx.withColumn("a", rules.rules_stage(text, F.col("holder")))
    mixed = tx.withColumn("a", rules.rules_stage(text, F.col("holder"), card_as_category=True))
    assert plain.filter("id = 5").first()["a"]["label"] == "Farmácia"
    assert mixed.filter("id = 5").first()["a"]["label"] == "débito"
    assert mixed.filter("id = 3").first()["a"]["label"] == "planilha comp"


def answers(**by_text):
    def score(texts):
        spark = texts.sparkSession
        rows = spark.createDataFrame([(k.replace("_", " "), *v) for k, v in by_text.items()], "text string, label string, confidence double")
        return texts.join(rows, "text")

    return score


def test_order_thresholds_and_default(tx):
    settings = cascade.Settings(use_rules=True, use_similarity=True)
    seen = []

    def watching(texts):
        seen.extend(r["text"] for r in texts.collect())
        return answers(padaria=("Supermercado", 0.8), uber_trip=("never", 1.0))(texts)

    stages = cascade.standard_stages(
        settings,
        rules=rules.rules_stage(T.rule_text(F.col("descr"))),
        similarity=cascade.TextStage("x", answers(padaria=("too low", 0.89)), F.col("descr")),
        model=cascade.TextStage("x", watching, F.col("descr")),
        reply=F.when(F.col("id") == 4, F.struct(F.lit("Viagens / Férias").alias("label"), F.lit(1.7).alias("confidence"))),
    )
    out = {r["id"]: (r["label"], r["confidence"], r["method_used"]) for r in cascade.classify(tx, stages).collect()}
    assert out[1][2] == out[2][2] == out[5][2] == "rules_engine"
    assert out[3] == out[6] == ("Supermercado", 0.8, "model_adapter")
    assert out[4] == ("Viagens / Férias", 1.0, "ai_fallback")
    assert out[7] == ("duvida", 0.3, "fallback")
    assert sorted(seen) == ["99 pop app", "padaria"]


def test_failed_rows(tx):
    stages = [cascade.ColumnStage("rules_engine", rules.rules_stage(T.rule_text(F.col("descr"))))]
    out = cascade.classify(tx, stages, failed=F.col("descr").isNull() | (F.col("amount") > 15))
    got = {r["id"]: (r["label"], r["confidence"], r["method_used"]) for r in out.collect()}
    assert got[7] == got[2] == ("duvida", 0.3, "error") and got[1][2] == "rules_engine"


def test_no_stage(tx):
    assert {r["method_used"] for r in cascade.classify(tx, []).collect()} == {"fallback"}


def test_legacy(tx):
    stages = cascade.legacy_stages(
        model=cascade.TextStage("x", answers(padaria=("Supermercado", 0.69), drogasil=("Farmácia", 0.7)), F.col("descr")),
        rules=rules.rules_stage(F.col("descr")),
    )
    out = {r["id"]: (r["label"], r["method_used"]) for r in cascade.classify(tx, stages, **cascade.LEGACY_DEFAULT).collect()}
    assert out[5] == ("Farmácia", "ml_model") and out[1][1] == "rules_engine" and out[3] == ("Gastos pessoais", "default")


def test_rules_that_share_a_pattern_meet_texts_once(spark, monkeypatch):
    """Thousands of rules on one pattern send one pattern to the driver; the first fitting rule still wins."""
    sent = []

    def noted(text, listed):
        sent.extend(listed)
        return candidates(text, listed)

    candidates = rules.patterns.candidates
    monkeypatch.setattr(rules.patterns, "candidates", noted)
    # Rules 0..9 have limits on the amount, all others none; on "b" a rule with a limit comes between.
    rows = [(i, f"a{i}", "literal", "aa", "X", 0.9, 0.0 if i < 10 else None, float(i) if i < 10 else None) for i in range(3000)]
    rows += [(5, "b5", "regex", "b+", "Y", 0.8, None, 7.0), (9, "b9", "regex", "b+", "Y", 0.8, None, None), (20, "b20", "regex", "b+", "Y", 0.8, None, 100.0)]
    table = spark.createDataFrame(rows, "priority int, name string, kind string, pattern string, category string, confidence double, amount_min double, amount_max double")
    table = table.selectExpr("*", "cast(null as string) holder", "cast(null as string) origin", "cast(null as int) installments")
    df = spark.createDataFrame([("xaa", 4.5), ("xaa", 50.0), ("aab", 6.5), ("aab", 50.0), ("b", 6.0), ("b", 8.0), ("c", 1.0)], "t string, amount double")
    wanted = [("aab", 6.5, "b5"), ("aab", 50.0, "b9"), ("b", 6.0, "b5"), ("b", 8.0, "b9"), ("c", 1.0, None), ("xaa", 4.5, "a5"), ("xaa", 50.0, "a10")]
    for block in (1 << 20, 1):
        sent.clear()
        got = rules.match_rule_table(df, table, "t", ("amount",), block)
        assert sorted((r["t"], r["amount"], r["rule"] and r["rule"]["rule"]) for r in got.collect()) == sorted(wanted, key=lambda r: r[:2])
        assert len(sent) == 2


def test_stages_in_front_of_a_text_stage_run_once(spark, monkeypatch):
    """The rows are written behind the column stages; both text stages and the result read them."""
    names = []

    def noted(df, name):
        names.append(name)
        return materialise(df, name)

    materialise = cascade.materialise
    monkeypatch.setattr(cascade, "materialise", noted)
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "t string")

    def knows(word):
        return lambda texts: texts.filter(F.col("text") == word).selectExpr("text", "upper(text) as label", "1.0D as confidence")

    rule = F.when(F.col("t") == "a", F.struct(F.lit("rule").alias("label"), F.lit(1.0).alias("confidence")))
    stages = [cascade.ColumnStage("r", rule), cascade.TextStage("s", knows("b"), F.col("t")), cascade.TextStage("m", knows("c"), F.col("t"))]
    got = {r["t"]: (r["label"], r["method_used"]) for r in cascade.classify(df, stages).collect()}
    assert got == {"a": ("rule", "r"), "b": ("B", "s"), "c": ("C", "m")}
    assert names.count("cascade-rows") == 1
