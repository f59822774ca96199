"""Plans from evidence: aligned pairs of tables, matched records, a column alone; and prompts."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import values as v
from ..operators import scoring
from ..operators.profile import Profile, data_columns, frequencies, profile, value_counts, with_row_id
from . import execute, ir


def paired_plan(dirty: DataFrame, clean: DataFrame) -> dict:
    """The plan that an aligned dirty and clean table show, by _rid: spellings that go to one gold are
    mapped, those that go to several are flagged."""
    prof = {c.name: c for c in profile(dirty).columns}
    found = scoring.derived_entries(dirty, clean).orderBy("column", "raw", "canonical").collect()
    columns, flags = [], []
    for name in data_columns(dirty):
        rows = [r for r in found if r["column"] == name]
        mapping = {r["raw"]: r["canonical"] for r in rows if not r["ambiguous"]}
        ops = [{"op": "canonicalize_categories", "mapping": mapping, "rationale": f"{len(mapping)} spelling(s) with their gold."}] if mapping else []
        columns.append({"name": name, "detected_semantic_type": prof[name].type, "issues": prof[name].issues, "operations": ops})
        unsure = sorted({r["raw"] for r in rows if r["ambiguous"]})
        if unsure:
            flags.append({"column": name, "issue": "ambiguous_or_missing_source_values", "values": unsure[:20], "action": "flag_only", "rationale": "Values with several golds."})
    return {"dataset_summary": f"Derived from a pair of tables: {sum(bool(c['operations']) for c in columns)} mapping(s).", "table_operations": [], "columns": columns, "flags": flags, "_generated_by": "pair"}


def matched_pairs(a: DataFrame, b: DataFrame, matches: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(messy, canonical) tables of records that `matches` (a_id, b_id) pairs; a is canonical, and the
    first match of each of its records counts. Where both disagree by more than spelling, neither is
    an error: the messy value stands on both sides."""
    names = [c for c in a.columns if c in b.columns and c != key]
    first = matches.groupBy("a_id").agg(F.min("b_id").alias("b_id"))
    left = a.select(F.col(key).alias("a_id"), F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in names)).alias("a"))
    right = b.select(F.col(key).alias("b_id"), F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in names)).alias("b"))
    both = with_row_id(first.join(left, "a_id").join(right, "b_id"))
    messy = both.select(F.col("a_id").alias("_rid"), *(F.col(f"b.`{c}`").alias(c) for c in names))
    gold = both.select(F.col("a_id").alias("_rid"), *(F.when(F.coalesce(scoring.is_variant(F.col(f"b.`{c}`"), F.col(f"a.`{c}`")), F.lit(False)), F.col(f"a.`{c}`")).otherwise(F.col(f"b.`{c}`")).alias(c) for c in names))
    return messy, gold


def column_mapping(counts: DataFrame, least: int = 20) -> DataFrame:
    """(column, raw, canonical) that columns show on their own: spellings go to the most frequent of
    their letters and digits, then rare values to one three times as frequent that they are a
    spelling of. Only columns of 20 cells and 4 to 0.7 n values, with two entries at least."""
    from ..operators.canon import near_keys

    shape = counts.groupBy("column").agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("values")).where((F.col("cells") >= least) & (F.col("values") >= 4) & (F.col("values") <= 0.7 * F.col("cells")))
    mine = counts.join(F.broadcast(shape.select("column")), "column").withColumn("norm", v.surface(F.col("value")))
    top = mine.groupBy("column", "norm").agg(F.max(F.struct("n", -F.col("first"), "value")).alias("m")).select("column", "norm", F.col("m.value").alias("canonical"), F.col("m.n").alias("n_canonical"), F.col("m.col2").alias("order"))
    same = mine.join(top, ["column", "norm"]).where(F.col("value") != F.col("canonical")).select("column", F.col("value").alias("raw"), "canonical")
    rare = mine.join(same.select("column", F.col("raw").alias("value")), ["column", "value"], "left_anti").where((F.col("n") < 3) & (F.col("norm") != "")).select("column", "value", "n", "norm")
    goals = top.where(F.col("norm") != "").select(F.col("column").alias("c2"), F.col("norm").alias("goal"), "canonical", "n_canonical", "order")
    near = near_keys(rare, "norm", True).join(near_keys(goals, "goal").withColumnRenamed("near", "near_goal"), (F.col("column") == F.col("c2")) & (F.col("near") == F.col("near_goal")))
    near = near.where((F.col("norm") != F.col("goal")) & (F.col("n_canonical") >= 3 * F.col("n")) & (F.levenshtein("norm", "goal", 1) == 1)).where(scoring.is_variant(F.col("value"), F.col("canonical")))
    typos = near.groupBy("column", F.col("value").alias("raw")).agg(F.max(F.struct("n_canonical", "order", "canonical")).alias("m")).select("column", "raw", F.col("m.canonical").alias("canonical"))
    every = same.unionByName(typos)
    many = every.groupBy("column").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("column")
    return every.join(F.broadcast(many), "column")


def embedded_alerts(df: DataFrame, plan: dict, looked: int | None = 400, whole: bool = False) -> DataFrame:
    """(column, pii_type, count, example): cards and SSNs inside the first `looked` cells, or with None
    all cells, of columns that the plan hasn't typed as personal data; the example is masked. `whole`
    is that of `pii.embedded`."""
    typed = {c["name"] for c in plan.get("columns", []) if any("pii" in o["op"] for o in c["operations"])}
    names = [c for c in data_columns(df) if c not in typed]
    df = with_row_id(df) if looked is None else with_row_id(df).orderBy("_rid").limit(looked)
    found = df.select("_rid", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for c in names))))
    hits = found.select("_rid", "column", F.posexplode(pii.embedded(F.col("cell"), whole)).alias("pos", "x"))
    by = hits.groupBy("column", F.col("x.pii_type").alias("pii_type")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_rid", "pos", "x.span")).alias("first"))
    top = by.groupBy("column").agg(F.sum("n").alias("count"), F.max(F.struct("n", F.col("pii_type") == "credit_card", "pii_type")).alias("m"), F.min("first").alias("first"))
    return top.select("column", F.col("m.pii_type").alias("pii_type"), "count", pii.mask(F.col("first.span")).alias("example"))


def types_by_model(counts: DataFrame, tagger, sensitive: dict[str, str], most: int = 40, coverage: float = 0.55) -> DataFrame:
    """(column, pii_type, hit_rate): a second tier for names and addresses. tagger() makes, once for
    each worker, a function from a value to its labels; `sensitive` says which labels count as what."""
    import pandas as pd

    from ..operators.profile import first_values

    def tag(batches):
        label = tagger()
        for b in batches:
            kinds = [sorted({sensitive[x] for x in label(value) if x in sensitive}) for value in b["value"]]
            yield pd.DataFrame({"column": b["column"], "kinds": kinds})

    first = first_values(counts, most).select("column", "value")
    votes = first.mapInPandas(tag, "column string, kinds array<string>")
    size = first.groupBy("column").agg(F.count(F.lit(1)).alias("size")).where("size >= 3")
    top = votes.select("column", F.explode("kinds").alias("pii_type")).groupBy("column", "pii_type").agg(F.count(F.lit(1)).alias("n")).join(size, "column")
    best = top.groupBy("column").agg(F.max(F.struct((F.col("n") / F.col("size")).alias("rate"), "pii_type")).alias("m")).where(F.col("m.rate") >= coverage)
    return best.select("column", F.col("m.pii_type").alias("pii_type"), F.round("m.rate", 3).alias("hit_rate"))


SYSTEM = "You write cleaning plans for tables as JSON: table_operations, columns with operations, and flags for what is not sure. Operations: " + ", ".join(ir.OPS) + ". Map rare or misspelt values to the label that the column itself has; leave out what you are not sure of."


def prompt(prof: Profile, rows: list[dict], candidates: dict | None = None, shown: int = 3) -> str:
    """What a language model is given to plan by: the profile, some rows, and allowed candidates."""
    columns = [{k: c[k] for k in ("name", "detected_semantic_type", "n_missing", "n_unique", "issues", "value_counts", "suspect_values")} | {"more_distinct_values": c["truncated_values"]} for c in prof.as_dict()["columns"]]
    body: dict = {"profile": {**{k: x for k, x in prof.as_dict().items() if k != "columns"}, "columns": columns}, "sample_rows": rows[:shown]}
    if candidates:
        body["candidate_pairs"] = candidates
    rule = "\nMap a value only to one of its candidates, or leave it out." if candidates else ""
    return f"Profile and sample:\n{json.dumps(body, ensure_ascii=False, indent=2, default=str)}{rule}\n\nAnswer with the plan as JSON."


def chat_example(prof: Profile, rows: list[dict], plan: dict) -> dict:
    return {"messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt(prof, rows)}, {"role": "assistant", "content": ir.serialize(plan)}]}


# Made tables, for tests and training sets.

_LABELS = {"status": ["Won", "Lost", "Open"], "department": ["Sales", "Finance", "Support", "Research"], "country": ["Canada", "Germany", "Japan"]}


def made_example(seed: int, rows: int = 40) -> tuple[list[dict], list[dict], dict]:
    """(clean rows, dirty rows, plan) from a seed: labels with spellings, money, dates, flags."""
    r = random.Random(seed)
    kinds = r.sample(sorted(_LABELS), 2)
    mapping: dict[str, dict[str, str]] = {k: {} for k in kinds}
    clean, dirty = [], []
    for i in range(rows):
        c: dict = {k: r.choice(_LABELS[k]) for k in kinds}
        d = dict(c)
        for k in kinds:
            if r.random() < 0.15:
                other = r.choice([c[k].upper(), c[k].lower(), c[k][:-1] + "x"])
                if other != c[k]:
                    d[k] = other
                    mapping[k][other] = c[k]
        amount = round(r.uniform(1, 9999), 2)
        c["amount"], d["amount"] = amount, r.choice([f"${amount:,.2f}", f"{amount:.2f}", f" {amount:,.2f}"])
        day = f"2023-{r.randint(1, 12):02}-{r.randint(13, 28)}"
        y, m, dd = day.split("-")
        c["day"], d["day"] = day, r.choice([day, f"{dd}/{m}/{y}", f"{int(m)}/{dd}/{y}"])
        c["active"] = r.random() < 0.5
        d["active"] = r.choice(["yes", "Y", "TRUE"] if c["active"] else ["no", "N", "false"])
        clean.append({"_rid": i, **c})
        dirty.append({"_rid": i, **d})
    ops = [{"name": k, "operations": [{"op": "canonicalize_categories", "mapping": mapping[k]}]} for k in kinds if mapping[k]]
    ops += [{"name": "amount", "operations": [{"op": "strip_whitespace"}, {"op": "parse_currency"}]}, {"name": "day", "operations": [{"op": "parse_date"}]}, {"name": "active", "operations": [{"op": "standardize_boolean"}]}]
    return clean, dirty, {"dataset_summary": "made", "table_operations": [], "columns": ops, "flags": []}


def verified_example(clean: DataFrame, dirty: DataFrame, plan: dict) -> bool:
    """Whether the plan turns the dirty table into the clean one, cell by cell."""
    out = execute.apply(dirty, plan).rows
    return scoring.recovery(clean, out).first()["recovery"] == 1.0


def gate_point(dirty: DataFrame, clean: DataFrame, plan: dict, tau: float = 0.5, with_heuristic: bool = True) -> DataFrame:
    """One row: what is left of a plan's mappings at a confidence, with the heuristic plan's, and how well
    these alone repair: tau, precision, coverage, changed, fixed."""
    from . import planner

    kept = planner.verify(dirty, plan, tau)
    if with_heuristic:
        kept = ir.union(kept, planner.heuristic(dirty))
    got = scoring.score(dirty, clean, execute.apply(dirty, ir.repairs_only(kept)).rows)
    return got.select(F.lit(float(tau)).alias("tau"), F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("coverage"), "changed", "fixed")


def made_personal_data(seed: int, rows: int = 120) -> list[dict]:
    """Rows with a card and an account number whose checksums are right, an SSN, an address and a city."""
    r = random.Random(seed)
    number = lambda n: "".join(str(r.randint(0, 9)) for _ in range(n))

    def card() -> str:
        body = "4" + number(14)
        doubled = sum(sum(divmod(2 * int(c), 10)) for c in body[::2]) + sum(int(c) for c in body[1::2])
        return body + str(-doubled % 10)

    def account() -> str:
        body = number(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"  # D and E are 13 and 14

    return [{"_rid": i, "card": card(), "iban": account(), "ssn": f"{r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", "email": f"p{number(3)}@mail{r.randint(1, 9)}.org", "city": r.choice(["Leeds", "Oslo", "Lima", "Turin"])} for i in range(rows)]


def unpaired(df: DataFrame) -> dict:
    """A plan from the columns of a table alone; see column_mapping."""
    by: dict[str, dict[str, str]] = {}
    for r in column_mapping(value_counts(frequencies(df))).collect():
        by.setdefault(r["column"], {})[r["raw"]] = r["canonical"]
    columns = [{"name": c, "detected_semantic_type": "categorical", "issues": [], "operations": [{"op": "canonicalize_categories", "mapping": by[c], "rationale": "Spellings of more frequent labels."}]} for c in data_columns(df) if c in by]
    return {"dataset_summary": "Derived from the table alone.", "table_operations": [], "columns": columns, "flags": [], "_generated_by": "unpaired"}


def sampled_labels(dirty: DataFrame, clean: DataFrame, k: int, seed: int) -> DataFrame:
    """(_rid, column, raw, gold): k wrong cells drawn by hash, to calibrate a plan by."""
    wrong = scoring.edits(dirty, clean).select("_rid", "column", F.col("before").alias("raw"), F.col("after").alias("gold"))
    return wrong.orderBy(F.xxhash64(F.lit(seed), "_rid", "column"), "_rid", "column").limit(k)


def every_kth(rows: DataFrame, wrong, k: int) -> DataFrame:
    """Rows with an error, and each k-th of the others in the order of their ids. The order is that of
    ranges of ids first, so that no task numbers all rows."""
    marked = with_row_id(rows).withColumn("__wrong", wrong).withColumn("__slot", F.floor(F.col("_rid") / 4096))
    slots = marked.where("not __wrong").groupBy("__slot").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)  # a 4096th of the rows
    start = slots.select("__slot", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__slot", "__wrong").orderBy("_rid")) - 1 + F.coalesce("__start", F.lit(0))
    out = marked.join(start, "__slot", "left").withColumn("__place", place).where(F.col("__wrong") | (F.pmod("__place", F.lit(k)) == 0))
    return out.drop("__wrong", "__slot", "__start", "__place")
