"""Graph metadata in built-in expressions: against the rules in Python, over drawn graphs and awkward ones."""

import json
import random

from pyspark.sql import functions as F

from vireo.functions import graphs, metadata

CLASSES = ["CLIPTextEncode", "CLIPTextEncodeSDXL", "CheckpointLoaderSimple", "UNETLoader", "LoraLoader", "KSampler", "KSamplerAdvanced", "SamplerCustomAdvanced", "My Model Thing", "Other", ""]
NAMES = ["text", "ckpt_name", "unet_name", "lora_name", "seed", "noise_seed", "x"]
FLOATS = [0.5, 1.0, 1e20, 1e16, 123456789012345680.0, 1e-5, 0.0001, -2.5e-7, 100.25, 1e22, 12345678.0, 1e15, 3e-310, 1.7976931348623157e308, 0.1 + 0.2]
ODD_INPUTS = [[], ["text"], ["lora_name"], ["seed"], [5, "seed"], "", "my seed", "plain", 5, None, True, 0.5]


def drawn_value(r, deep=True):
    kinds = [lambda: "".join(r.choices("ab é\"\\", k=r.randint(0, 5))), lambda: r.randint(-(2**70), 2**70), lambda: r.randint(-9, 9), lambda: r.choice(FLOATS), lambda: r.random() < 0.5, lambda: None]
    if deep:
        kinds += [lambda: [drawn_value(r, False) if r.random() < 0.8 else r.choice([[1], {"a": 1}]) for _ in range(r.randint(0, 3))], lambda: {}]
    return r.choice(kinds)()


def drawn_graph(r):
    def node():
        if r.random() < 0.06:
            return r.choice([1, "s", None, [1]])
        out = {}
        if r.random() < 0.9:
            out["class_type"] = r.choice(CLASSES) if r.random() < 0.97 else r.choice([0, 1, None, []])
        if r.random() < 0.9:
            out["inputs"] = {n: drawn_value(r) for n in r.sample(NAMES, r.randint(0, 4))} if r.random() < 0.95 else r.choice(ODD_INPUTS)
        return out

    return {k: node() for k in r.sample(["1", "10", "9", "2", "b", "a"], r.randint(0, 5))}


def whole(text):
    """A number as VARIANT reads it: 5.0 is 5."""
    return int(text.split(".")[0]) if "e" not in text.lower() and not text.split(".")[1].strip("0") else float(text)


def want(text):
    try:
        graph = json.loads(text, parse_float=whole) if text else None
    except ValueError:
        return ("", "", "", True)
    try:
        found = metadata.graph_fields(graph) if graph else metadata.EMPTY
    except metadata.Malformed:
        return ("", "", "", False)
    return (found["prompt"], found["model"], found["seed"], True)


def check(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: (r["prompt"], r["model"], r["seed"], r["ok"]) for r in rows.select("k", graphs.graph_metadata(F.col("t")).alias("m")).select("k", "m.*").collect()}
    bad = [(texts[k], got[k], want(texts[k])) for k in got if got[k] != want(texts[k])]
    assert not bad, bad[:3]


def test_drawn_graphs(spark):
    r = random.Random(8)
    check(spark, [json.dumps(drawn_graph(r), ensure_ascii=bool(k % 2)) for k in range(3000)])


def test_awkward_graphs(spark):
    node = '{"class_type":"CLIPTextEncode","inputs":{"text":"%s"}}'
    twice = '{"1":%s,"2":%s,"1":%s}' % (node % "aa", node % "bb", node % "cc")
    check(spark, [None, "", " ", "null", "junk", "[]", "[1]", "{}", " { } ", "0", "0.0", "5", "true", "false", '""', '"x"', "[[]]", twice, '{"1":', "{'1': 2}", '{"1":{"inputs":{"seed":18446744073709551616}}}', '{"a":{"class_type":null}}', '{"a":{"inputs":null}}', '{"1":{"inputs":{"seed":5}}, junk', '{"1":{"inputs":{"seed":5}}'])


def test_long_texts_and_workflow(spark):
    graph = json.dumps({str(k): {"class_type": "CLIPTextEncode", "inputs": {"text": "é" * k}} for k in random.Random(1).sample(range(3000), 40)})
    check(spark, [graph])
    row = spark.createDataFrame([("{}" * 30_000, True), (None, True), ("x", False)], "w string, ok boolean").select(graphs.workflow_text(F.col("w"), F.col("ok")).alias("w")).collect()
    assert [len(r["w"]) for r in row] == [metadata.WORKFLOW_CHARS, 0, 0]


def test_no_python_in_the_plan(spark):
    plan = spark.range(1).select(graphs.graph_metadata(F.col("id").cast("string")).alias("m"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
