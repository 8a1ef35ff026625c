"""Generation metadata of node graphs in JSON, in built-in expressions: prompt, model and seed, by rules over nodes in document order.

A graph is read as an ordered map of VARIANT values, so the order of nodes and the types of values are those of the text: of a key
that stands twice the last value counts, at the first one's place. A number whose fraction is zero is a whole one. Rules are fixed values; which of several statements counts follows
from whole lists of statements. A graph of another shape than the rules read has no fields at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vireo.functions.metadata import ADDED_MODEL_NAMES, MAIN_MODEL_NAMES, MODEL_CLASSES, NOISE_CLASSES, PROMPT_CLASSES, WORKFLOW_CHARS


def let(value: Column, use) -> Column:
    """use(value), the value worked out once and named: a function of an array's one element. Without it, what is used twice stands twice in the plan."""
    return F.transform(F.array(value), use)[0]


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, NUMBER or VOID (JSON null) of a variant; null for a null column (nothing there)."""
    return F.regexp_replace(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), "^(BIGINT|DECIMAL|DOUBLE|FLOAT)$", "NUMBER")


def _python_float(text: Column) -> Column:
    """A double as Java writes it, as Python does: by its shortest digits, with an exponent below 1e-4 and from 1e16 on."""
    empty = F.lit("")
    parts = lambda t: F.struct(F.regexp_extract(t, "^-", 0).alias("sign"), F.split(F.regexp_extract(t, r"^-?(\d+\.\d+)", 1), r"\.").alias("d"), F.coalesce(F.regexp_extract(t, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0)).alias("e"))
    # digits without zeros at either end, and the power of the first of them
    scaled = lambda p: F.struct(p["sign"].alias("sign"), F.concat(p["d"][0], p["d"][1]).alias("all"), (F.length(p["d"][0]) + p["e"] - 1).alias("lead"))
    bared = lambda p: F.struct(p["sign"].alias("sign"), F.regexp_replace(F.regexp_replace(p["all"], "^0+", ""), "0+$", "").alias("d"), (p["lead"] - F.length(F.regexp_extract(p["all"], "^0*", 0))).alias("lead"))

    def written(p: Column) -> Column:
        d, lead = p["d"], p["lead"]
        power = F.concat(F.when(lead < 0, "e-").otherwise("e+"), F.when(F.abs(lead) < 10, "0").otherwise(empty), F.abs(lead).cast("string"))
        exponent = F.concat(F.regexp_replace(d, "^(.)(.+)$", "$1.$2"), power)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(F.lit(0), -lead - 1)), d)
        whole = F.concat(F.rpad(d, lead + 1, "0"), F.lit("."), F.coalesce(F.nullif(F.substring(d, lead + 2, F.lit(400)), empty), F.lit("0")))
        number = F.when(d == "", F.lit("0.0")).when((lead < -4) | (lead >= 16), exponent).when(lead < 0, small).otherwise(whole)
        return F.concat(p["sign"], number)

    return F.when(text.isin("Infinity", "-Infinity"), F.replace(text, F.lit("Infinity"), F.lit("inf"))).otherwise(let(let(let(parts(text), scaled), bared), written))


def _scalar(value: Column, kind: Column) -> Column:
    """A string, number or truth value as text; empty for null."""
    is_whole = F.schema_of_variant(value).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    number = F.when(is_whole, F.try_variant_get(value, "$", "decimal(38,0)").cast("string")).otherwise(let(F.try_variant_get(value, "$", "double").cast("string"), _python_float))
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "STRING", text).when(kind == "NUMBER", number).when(kind == "BOOLEAN", F.initcap(text)).otherwise(F.lit(""))


def _kinded(value: Column) -> Column:
    return F.struct(value.alias("v"), F.coalesce(kind_of(value), F.lit("VOID")).alias("k"))


def plain(value: Column) -> Column:
    """A value as text: scalars as such, of a list its scalars joined (null is an empty place), nothing for what is nested."""
    items = lambda v: F.when(v["k"] == "ARRAY", F.transform(F.try_variant_get(v["v"], "$", "array<variant>"), _kinded)).otherwise(F.array(v))
    scalars = lambda v: F.filter(items(v), lambda x: ~x["k"].isin("OBJECT", "ARRAY"))
    return let(_kinded(value), lambda v: F.array_join(F.transform(scalars(v), lambda x: F.coalesce(_scalar(x["v"], x["k"]), F.lit(""))), ", "))


def _first_held(inputs: Column, names: tuple[str, ...]) -> Column:
    """The value (a variant) of the first of names that an object has; null if there is none."""
    return F.coalesce(*(F.try_variant_get(inputs, f"$.{n}", "variant") for n in names))


def _spoils(inputs: Column, kind: Column, names: tuple[str, ...]) -> Column:
    """Whether inputs are nothing that can be asked for names: a list or a string that holds one, or another value."""
    listed = F.exists(F.try_variant_get(inputs, "$", "array<variant>"), lambda x: F.coalesce((kind_of(x) == "STRING") & F.try_variant_get(x, "$", "string").isin(*names), F.lit(False)))
    within = F.try_variant_get(inputs, "$", "string").rlike("|".join(names))
    return F.when(kind == "OBJECT", False).when(kind == "ARRAY", listed).when(kind == "STRING", within).otherwise(True)


def _node(value: Column) -> Column:
    """What a node says: bad (it can't be read), prompt, main, added and seed (text; null where it says nothing)."""

    def parts(v: Column) -> Column:
        kind, inputs = F.try_variant_get(v, "$.class_type", "variant"), F.coalesce(F.try_variant_get(v, "$.inputs", "variant"), F.try_parse_json(F.lit("{}")))
        return F.struct(F.coalesce(kind_of(kind), F.lit("STRING")).alias("name_kind"), F.coalesce(F.try_variant_get(kind, "$", "string"), F.lit("")).alias("name"), inputs.alias("inputs"), kind_of(inputs).alias("shape"))

    def asked(p: Column) -> Column:
        is_model = p["name"].isin(*MODEL_CLASSES) | F.lower(p["name"]).contains("model")
        kept = [p[c].alias(c) for c in ("name_kind", "inputs", "shape")]
        return F.struct(*kept, p["name"].isin(*PROMPT_CLASSES).alias("is_prompt"), is_model.alias("is_model"), p["name"].isin(*NOISE_CLASSES).alias("noisy"))

    def said(p: Column) -> Column:
        i, k = p["inputs"], p["shape"]
        held = lambda names: F.when(k == "OBJECT", _first_held(i, names))
        bad = (p["name_kind"] != "STRING") | (p["is_prompt"] & (k != "OBJECT")) | F.when(p["noisy"], _spoils(i, k, ("seed", "noise_seed"))).otherwise(_spoils(i, k, ("seed",)))
        bad = bad | (p["is_model"] & (_spoils(i, k, MAIN_MODEL_NAMES) | _spoils(i, k, ADDED_MODEL_NAMES)))
        main = F.when(p["is_model"], held(MAIN_MODEL_NAMES))
        seed = F.when(p["noisy"], held(("seed", "noise_seed"))).otherwise(held(("seed",)))
        return F.struct(bad.alias("bad"), F.when(p["is_prompt"], held(("text",))).alias("prompt"), main.alias("main"), F.when(p["is_model"], held(ADDED_MODEL_NAMES)).alias("added"), seed.alias("seed"))

    text = lambda v: F.when(v.isNotNull(), plain(v))

    def told(n: Column) -> Column:
        prompt = F.when(kind_of(n["prompt"]) == "STRING", F.try_variant_get(n["prompt"], "$", "string"))
        return F.struct(n["bad"].alias("bad"), prompt.alias("prompt"), text(n["main"]).alias("main"), F.when(n["main"].isNull(), text(n["added"])).alias("added"), text(n["seed"]).alias("seed"))

    return let(let(let(let(value, parts), asked), said), told)


def _ordered(entries: Column) -> Column:
    """Values of a map's entries, each key once: the last value at the first place."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return let(keys, lambda ks: F.when(F.size(ks) == F.size(entries), F.transform(entries, lambda e: e["value"])).otherwise(F.transform(ks, last)))


def graph_metadata(graph: Column) -> Column:
    """prompt, model and seed of a node graph in JSON, as a struct, and ok: whether it could be read as the rules need it. What is no
    JSON, or empty, has no fields and is ok; what follows a graph's end isn't looked at. Keys that stand twice within a node are read where spark.sql.variant.allowDuplicateKeys
    is set; without it, such a graph counts as no JSON.

    prompt: the longest string, of equals the first. seed: the last one. model: the last main one; if that is empty, the first
    added one after it that isn't.
    """
    empty = F.lit("")
    none = lambda ok: F.struct(empty.alias("prompt"), empty.alias("model"), empty.alias("seed"), ok.alias("ok"))

    def fields(said: Column) -> Column:
        longest = F.aggregate(said, empty, lambda acc, n: F.when(F.length(n["prompt"]) > F.length(acc), n["prompt"]).otherwise(acc))
        seed = F.aggregate(said, empty, lambda acc, n: F.coalesce(n["seed"], acc))
        model = F.aggregate(said, empty, lambda acc, n: F.when(n["main"].isNotNull(), n["main"]).when((acc == "") & n["added"].isNotNull(), n["added"]).otherwise(acc))
        found = F.struct(longest.alias("prompt"), model.alias("model"), seed.alias("seed"), F.lit(True).alias("ok"))
        return F.when(said.isNull(), none(F.lit(True))).when(F.exists(said, lambda n: n["bad"]), none(F.lit(False))).otherwise(found)

    def of_text(text: Column) -> Column:
        objects = lambda entries: F.filter(_ordered(entries), lambda v: F.coalesce(kind_of(v), F.lit("VOID")) == "OBJECT")
        nodes = let(let(F.map_entries(F.from_json(text, "map<string,variant>")), objects), lambda vs: F.transform(vs, _node))
        # false, 0, "", null and empty lists are nothing; other scalars and lists are graphs of a wrong shape
        wrong = let(_kinded(F.try_parse_json(text)), lambda w: (w["k"] != "VOID") & ~text.rlike(r'^(false|""|\[\s*\])$') & ~F.coalesce((w["k"] == "NUMBER") & (F.try_variant_get(w["v"], "$", "double") == 0), F.lit(False)))
        return F.when(text.startswith("{"), let(nodes, fields)).otherwise(none(~wrong))

    return let(F.trim(F.coalesce(graph, empty)), of_text)


def workflow_text(workflow: Column, ok: Column) -> Column:
    """The workflow as it was given, cut to its first WORKFLOW_CHARS characters; empty where there is none, or where the graph couldn't be read."""
    return F.when(ok, F.substring(F.coalesce(workflow, F.lit("")), 1, WORKFLOW_CHARS)).otherwise(F.lit(""))
