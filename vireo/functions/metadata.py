"""Generation metadata from the node graphs that image tools put into PNG text.

The rules are data: which node classes and input names speak of which field, and which of several statements counts.
reading() collects the statements of a graph in document order; the fields are then chosen from whole lists of statements.
A graph that can't be read as the rules need it (Malformed) gives no field at all, and loses the workflow too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from vireo.sources import png

# Node classes and input names.
PROMPT_CLASSES = ("CLIPTextEncode", "CLIPTextEncodeSDXL")
MODEL_CLASSES = ("CheckpointLoaderSimple", "UNETLoader", "LoraLoader")
NOISE_CLASSES = ("KSampler", "KSamplerAdvanced", "SamplerCustomAdvanced")
MAIN_MODEL_NAMES, ADDED_MODEL_NAMES = ("ckpt_name", "unet_name"), ("lora_name",)
WORKFLOW_CHARS = 50_000

EMPTY = {"prompt": "", "model": "", "seed": ""}


class Malformed(ValueError):
    """A graph of another shape than the rules read."""


def plain(value: object) -> str:
    """A value as text: scalars as such, of a list its scalars joined (null is an empty place), nothing for what is nested."""
    places = value if isinstance(value, list) else [value]
    return ", ".join(str(x) if isinstance(x, (str, int, float)) else "" for x in places if not isinstance(x, (list, dict)))


def _first_held(inputs: object, names: tuple[str, ...]) -> list[object]:
    """The value of the first of names that inputs has, as a list of one; an empty list if there is none."""
    if isinstance(inputs, dict):
        return [inputs[n] for n in names if n in inputs][:1]
    if isinstance(inputs, (list, str)) and not any(n in inputs for n in names):
        return []
    raise Malformed(f"inputs of type {type(inputs).__name__}")


def reading(graph: object) -> Iterator[tuple[str, object]]:
    """Statements (field, value) of a graph's nodes in order: prompt, main model, added model and seed. Nodes that are no objects say nothing."""
    if not isinstance(graph, dict):
        raise Malformed(f"graph of type {type(graph).__name__}")
    for node in filter(lambda x: isinstance(x, dict), graph.values()):
        kind, inputs = node.get("class_type", ""), node.get("inputs", {})
        if not isinstance(kind, str):
            raise Malformed(f"class of type {type(kind).__name__}")
        if kind in PROMPT_CLASSES and not isinstance(inputs, dict):
            raise Malformed("inputs of a prompt node")
        asked = {"seed": ("seed", "noise_seed") if kind in NOISE_CLASSES else ("seed",)}
        if kind in PROMPT_CLASSES:
            asked["prompt"] = ("text",)
        if kind in MODEL_CLASSES or "model" in kind.lower():
            asked["main"] = MAIN_MODEL_NAMES
            if not _first_held(inputs, MAIN_MODEL_NAMES):
                asked["added"] = ADDED_MODEL_NAMES
        for field, names in asked.items():
            yield from ((field, x) for x in _first_held(inputs, names))


def graph_fields(graph: object) -> dict[str, str]:
    """prompt: the longest string, of equals the first. seed: the last. model: the last main one; if that is empty, the first added one after it that is not."""
    said = list(reading(graph))
    prompts = [x for field, x in said if field == "prompt" and isinstance(x, str)]
    seeds = [x for field, x in said if field == "seed"]
    models = [(field, plain(x)) for field, x in said if field in ("main", "added")]
    last = max((k for k, (field, _) in enumerate(models) if field == "main"), default=-1)
    in_force = models[max(last, 0) :]  # what stands before the last main model doesn't count
    return {"prompt": max(prompts, key=len, default=""), "model": next((x for _, x in in_force if x), ""), "seed": plain(seeds[-1]) if seeds else ""}


def graph_text_fields(text: str | None) -> dict[str, str] | None:
    """graph_fields() of a JSON text; what is no JSON, or empty, has no fields; None if the graph is malformed."""
    try:
        graph = json.loads(text) if text else None
    except ValueError:
        return dict(EMPTY)
    try:
        return graph_fields(graph) if graph else dict(EMPTY)
    except Malformed:
        return None


def extract(data: bytes | None) -> dict:
    """Size and metadata of a PNG; what is missing or malformed is empty, a size null."""
    out = {"width": None, "height": None, **EMPTY, "workflow": ""}
    if not data or (wh := png.size(data)) is None:
        return out
    out["width"], out["height"] = wh
    found = png.text(data)
    fields = graph_text_fields(found.get("prompt"))
    return out if fields is None else {**out, **fields, "workflow": found.get("workflow", "")[:WORKFLOW_CHARS]}
