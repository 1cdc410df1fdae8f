"""Label names, folder names and captions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of the classes, in class order.
SYNONYMS: dict[str, int] = {
    "explosive": 0, "explosives": 0, "ied": 0, "ieds": 0, "bomb": 0, "improvisedexplosivedevice": 0, "explosivedevice": 0, "detonator": 0,
    "gun": 1, "guns": 1, "pistol": 1, "handgun": 1, "firearm": 1, "revolver": 1,
    "3dgun": 2, "3dguns": 2, "3dprintedgun": 2, "3dprintedfirearm": 2, "printedgun": 2, "gun3d": 2, "threedgun": 2, "3dpistol": 2,
    "knife": 3, "knives": 3,
    "cutter": 4, "cutters": 4, "boxcutter": 4, "papercutter": 4, "utilityknife": 4,
    "blade": 5, "blades": 5, "razorblade": 5,
    "shavingrazor": 6, "razor": 6, "shaver": 6,
    "lighter": 7, "lighters": 7,
    "injection": 8, "injections": 8, "syringe": 8, "syringes": 8, "needle": 8,
    "battery": 9, "batteries": 9,
    "nailcutter": 10, "nailcutters": 10, "nailclipper": 10, "nailclippers": 10,
    "othersharpitem": 11, "othersharpitems": 11, "sharpitem": 11, "othersharp": 11, "sharpobject": 11,
    "powerbank": 12, "powerbanks": 12,
    "scissors": 13, "scissor": 13,
    "hammer": 14, "hammers": 14,
    "pliers": 15, "plier": 15,
    "wrench": 16, "wrenches": 16, "spanner": 16,
    "screwdriver": 17, "screwdrivers": 17,
    "handcuffs": 18, "handcuff": 18, "cuffs": 18,
    "bullet": 19, "bullets": 19, "ammunition": 19, "ammo": 19, "cartridge": 19,
}
# Labels that mean no threat, and labels without meaning.
IGNORED = ("nonthreat", "benign", "normal", "background", "bg", "none", "negative", "safe")
GENERIC = ("threat", "object", "item", "prohibited", "prohibiteditem", "dangerous", "target", "")
# Endings of mask files' names.
MASK_SUFFIXES = ("_mask", "-mask", "_seg", "-seg", "_gt", "_label", "_segmentation", "_bb", "_bbox")
# Words for how cluttered a bag is, and their levels.
CLUTTER: dict[str, int] = {
    "limited": 0, "light": 0, "low": 0, "minimal": 0, "medium": 1, "moderate": 1,
    "heavy": 2, "heavily": 2, "high": 2, "extreme": 3, "extremely": 3,
}


def label_class(raw: Column) -> Column:
    """Struct cls, status of a raw label; cls is -1 where there is no class.

    `class 4` is a number, `class 4_Knife` is read by its name. Exact spellings, numbers and marks
    of a class are settled on columns; only labels left over, as a rule few spellings, are compared
    by similarity in a vectorised function. Both kinds of guess have the status fuzzy.
    """
    plain = F.regexp_replace(F.lower(raw), r"^\s+|\s+$", "")
    head = r"(?s)^class[\s_-]*(\d+)[\s_:.-]*(.*)$"
    number, name = F.regexp_extract(plain, head, 1), F.regexp_extract(plain, head, 2)
    alone = (number != "") & (name == "")
    clean = F.regexp_replace(F.when(number != "", name).otherwise(plain), "[^a-z0-9]", "")
    value = F.when(alone, number).when(clean.rlike("^[0-9]+$"), clean).try_cast("long")
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.lit(v))])
    known = F.element_at(table, clean)
    made = lambda c, s: F.struct(c.cast("int").alias("cls"), F.lit(s).alias("status"))
    none = F.lit(-1)
    numeric = F.when(value.between(1, 20), made(value - 1, "numeric")).when(alone & (value == 22), made(none, "ignore")).otherwise(made(none, "unmapped"))
    return (
        F.when(raw.isNull(), made(none, "missing"))
        .when(alone, numeric)
        .when(clean.isin(*IGNORED), made(none, "ignore"))
        .when(clean.isin(*GENERIC), made(none, "generic"))
        .when(known.isNotNull(), made(known, "ok"))
        .when(clean.rlike("^[0-9]+$"), numeric)
        .when(clean.rlike("^3d|3dprint|printedgun"), made(F.lit(SYNONYMS["3dgun"]), "fuzzy"))
        .when(clean.rlike("^ied|explos|bomb"), made(F.lit(SYNONYMS["explosive"]), "fuzzy"))
        .otherwise(_nearest(clean))
    )


@F.pandas_udf(T.StructType([T.StructField("cls", T.IntegerType()), T.StructField("status", T.StringType())]))
def _nearest(clean: pd.Series) -> pd.DataFrame:
    """The longest spelling of at least four letters within a label, else the most similar one from 0.8 on."""
    names = sorted(SYNONYMS, key=lambda s: -len(s))
    seen: dict[str | None, tuple[int, str]] = {None: (-1, "missing")}
    for x in clean.dropna().unique():
        found = [s for s in names if len(s) >= 4 and s in x][:1] or difflib.get_close_matches(x, list(SYNONYMS), 1, 0.8)
        seen[x] = (SYNONYMS[found[0]], "fuzzy") if found else (-1, "unmapped")
    return pd.DataFrame([seen[None if pd.isna(x) else x] for x in clean], columns=["cls", "status"])


def folder_class(name: Column) -> Column:
    """Struct id, label of a class folder such as `Class 12_Other Sharp Item`; nulls where it isn't one."""
    pattern = r"(?i)^\s*class[\s_-]*(\d{1,4})[\s_.-]*(.*?)\s*$"
    number = F.regexp_extract(name, pattern, 1)
    return F.struct(F.when(number != "", number.try_cast("int")).alias("id"), F.when(number != "", F.regexp_extract(name, pattern, 2)).alias("label"))


def stem_key(path: Column) -> Column:
    """File name without folders, ending and one mask suffix, in lower case."""
    name = F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)
    stem = F.regexp_replace(F.lower(name), r"\.[^.]*$", "")
    return F.regexp_replace(stem, f"({'|'.join(MASK_SUFFIXES)})$", "")


def safe_name(text: Column) -> Column:
    """Runs of characters that a file name shouldn't have become `_`; `x` if nothing is left."""
    made = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(made == "", "x").otherwise(made)


def clutter_level(caption: Column) -> Column:
    """0 to 3 by the first word of a caption that says how cluttered the bag is, -1 where it has none."""
    word = F.lower(F.regexp_extract(caption, rf"(?i)\b({'|'.join(CLUTTER)})\b[\w\s-]{{0,15}}clutter", 1))
    table = F.create_map(*[x for k, v in CLUTTER.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, word), F.lit(-1))


def duration(seconds: Column) -> Column:
    """`1h02m` from an hour on, else `3m04s`; seconds are cut off."""
    s = F.floor(seconds).cast("long")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return F.when(s >= 3600, F.concat(h.cast("string"), F.lit("h"), pad(m), F.lit("m"))).otherwise(F.concat(m.cast("string"), F.lit("m"), pad(s % 60), F.lit("s")))
