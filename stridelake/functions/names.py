"""Strings and paths: joints, chains, data sets, families, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of motion names that make a family, in the order in which they count.
FAMILY_WORDS = (
    "idle", "look", "walk", "jog", "run", "turn", "jump", "hop", "kneel", "squat", "crouch", "sit", "stand", "lift", "pick", "put", "place", "throw",
    "catch", "push", "pull", "carry", "reach", "pocket_searching", "playing_recorder",
)
# Joints by limb.
ARM_JOINTS = ("shoulder", "elbow", "wrist")
LEG_JOINTS = ("hip", "knee", "ankle")
TORSO_JOINTS = ("waist", "head")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def side(joint: Column) -> Column:
    return F.when(F.startswith(joint, F.lit("left_")), "left").when(F.startswith(joint, F.lit("right_")), "right").otherwise("center")


def side_group(joint: Column, torso: str = "merged") -> Column:
    """Side and limb part of a joint (``left_elbow``, ``center_knee``).

    Waist and head are ``torso_head`` where ``torso`` is merged; where it is split they are parts like others, and what is no known part is ``other``.
    """
    parts = ("ankle", "knee", "hip", "wrist", "elbow", "shoulder")
    found = F.lit(None).cast("string")
    for name in reversed(parts if torso == "merged" else ("shoulder", "elbow", "wrist", "hip", "knee", "ankle", "waist", "head")):
        found = F.when(F.contains(joint, F.lit(name)), F.lit(name)).otherwise(found)
    named = F.concat_ws("_", side(joint), found)
    if torso != "merged":
        return F.when(found.isNull(), "other").otherwise(named)
    return F.when(found.isNotNull(), named).when(contains_any(joint, ("waist", "head")), "torso_head").otherwise(F.concat_ws("_", side(joint), F.lit("other")))


def chain(joint: Column) -> Column:
    """upper, lower, torso_head or other."""
    return F.when(contains_any(joint, ARM_JOINTS), "upper").when(contains_any(joint, LEG_JOINTS), "lower").when(contains_any(joint, TORSO_JOINTS), "torso_head").otherwise("other")


def limb(joint: Column) -> Column:
    """left_arm, right_arm, left_leg, right_leg, torso_head or other."""
    part = F.when(contains_any(joint, ARM_JOINTS), "arm").when(contains_any(joint, LEG_JOINTS), "leg")
    return F.when(part.isNotNull() & (side(joint) != "center"), F.concat_ws("_", side(joint), part)).when(contains_any(joint, TORSO_JOINTS), "torso_head").otherwise("other")


def path_parts(path: Column, mode: str = "full") -> dict[str, Column]:
    """dataset, category and subcategory of a relative path, by one of the rules in use.

    ``full``: a file of the data set seed has its second folder as category and subcategory, one of grab as subcategory, others have the data set as
    category and the second part as subcategory. The other rules give a data set and a subset: the second part for seed and grab, else the
    data set (``dataset``) or nothing (``flat`` and ``blank``); ``flat`` and ``blank`` take a file without folder as data set nutan, ``flat`` also names that
    set's subset. ``category``: the second part for seed, else the first.
    """
    parts = F.split(path, "/")
    depth, first, second = F.size(parts), parts[0], F.get(F.split(path, "/"), F.lit(1))
    deep = depth >= 2
    if mode == "category":
        return {"category": F.when(deep & (first == "seed"), second).otherwise(first)}
    if mode == "full":
        category = F.when(deep & (first == "seed"), second).otherwise(first)
        return {"dataset": first, "category": category, "subcategory": F.when(deep, second).otherwise(first)}
    special = deep & first.isin("seed", "grab")
    if mode == "dataset":
        return {"dataset": first, "subset": F.when(special, second).otherwise(first)}
    rest = F.when(first == "nutan", "nutan").otherwise("") if mode == "flat" else F.lit("")
    return {"dataset": F.when(deep, first).otherwise("nutan"), "subset": F.when(special, second).when(deep, rest).otherwise("nutan")}


def without_mirror(stem: Column) -> Column:
    return F.regexp_replace(stem, "_M$", "")


def without_actor(stem: Column) -> Column:
    """The stem without mirror mark and actor number."""
    return F.regexp_replace(without_mirror(stem), r"__A\d+$", "")


def family(stem: Column, keywords: tuple[str, ...] = FAMILY_WORDS) -> Column:
    """The first three keywords (in the order given) the name holds, joined by +; else its first three tokens that are no numbers or sides."""
    name = F.lower(without_actor(stem))
    hits = F.slice(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(name, k)), 1, 3)
    tokens = F.slice(F.filter(F.split(name, r"[_\W]+"), lambda t: (t != "") & ~t.rlike("^[0-9]+$") & ~t.isin("l", "r")), 1, 3)
    return F.when(F.size(hits) > 0, F.array_join(hits, "+")).when(F.size(tokens) > 0, F.array_join(tokens, "_")).otherwise(name)


def feature_group(feature: Column) -> Column:
    """What stands before the double underscore; ``unknown`` without one."""
    return F.when(F.contains(feature, F.lit("__")), F.substring_index(feature, "__", 1)).otherwise("unknown")


def metric_parts(metric: Column) -> dict[str, Column]:
    """``type/body->joint`` as error type, body and joint; missing parts are empty."""
    rest = F.when(F.contains(metric, F.lit("/")), F.substring_index(metric, "/", -1)).otherwise("")
    pair = F.contains(rest, F.lit("->"))
    return {"error_type": F.substring_index(metric, "/", 1), "body": F.when(pair, F.substring_index(rest, "->", 1)).otherwise(rest), "joint": F.when(pair, F.substring_index(rest, "->", -1)).otherwise("")}


def leaf(label: Column) -> Column:
    return F.substring_index(label, "/", -1)


def safe_name(text: Column) -> Column:
    """Runs of characters that file names should not have become one underscore; none at the ends."""
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def match_key(path: Column, marker: str, channel: str) -> Column:
    """Path after a marker folder, without extension and without a channel folder: what two trees of one corpus agree on."""
    parts = F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/")
    at = F.array_position(parts, marker)
    tail = F.when(at > 0, F.slice(parts, (at + 1).cast("int"), F.size(parts))).otherwise(parts)
    return F.array_join(F.filter(tail, lambda p: (p != channel) & (p != "")), "/")


def mirrored_joint(joint: Column) -> Column:
    """Left and Right exchanged."""
    return F.when(F.contains(joint, F.lit("Left")), F.replace(joint, F.lit("Left"), F.lit("Right"))).otherwise(F.replace(joint, F.lit("Right"), F.lit("Left")))


def rejoined(path: Column, root: str, other_root: str, channel: str, ending: str) -> Column:
    """A path below one root as the path of its partner below another: without the first folder named like the channel, with another ending."""
    parts = F.split(F.replace(path, F.lit(f"{root.rstrip('/')}/"), F.lit("")), "/")
    at = F.array_position(parts, channel)
    kept = F.when(at > 0, F.concat(F.slice(parts, F.lit(1), (at - 1).cast("int")), F.slice(parts, (at + 1).cast("int"), F.size(parts)))).otherwise(parts)
    return F.concat(F.lit(f"{other_root.rstrip('/')}/"), F.regexp_replace(F.array_join(kept, "/"), r"\.[^./]*$", ""), F.lit(ending))


def after_marker(path: Column, markers: tuple[str, ...]) -> tuple[Column, Column]:
    """What follows the first marker folder that the path has, and an error text where it has none (a row, not an exception)."""
    parts = F.split(path, "/")
    tail, found = F.lit(None).cast("string"), F.lit(False)
    for marker in reversed(markers):
        at = F.array_position(parts, marker)
        has = (at > 0) & (at < F.size(parts))
        tail = F.when(has, F.array_join(F.slice(parts, (at + 1).cast("int"), F.size(parts)), "/")).otherwise(tail)
        found = found | has
    return tail, F.when(~found, F.concat(F.lit(f"none of {', '.join(markers)} in "), path))


def plain_letters(text: Column) -> Column:
    """Every character that is no letter or digit becomes one underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def thresholds_of(text: Column) -> Column:
    """``a=1,b=3`` as a map of the numbers as they are; entries without a number go."""
    raw = F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda _, v: v.try_cast("double"))
    return F.map_filter(raw, lambda _, v: v.isNotNull())


def weights_of(text: Column) -> Column:
    """``a=1,b=3`` as a map whose values sum to 1."""
    raw = F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda _, v: v.try_cast("double"))
    total = F.aggregate(F.map_values(raw), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return F.transform_values(raw, lambda _, v: F.coalesce(v, F.lit(0.0)) / total)
