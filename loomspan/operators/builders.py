"""Record builders: pages (title, wikitext) to entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import clean_text, infobox_field, section, template_arg, template_params
from ..functions.names import page_url, slug
from ..functions.qa import length_flags
from ..functions.regex import bind

# Length limits, piece fields with labels, highest story number.
LIGHT_CONE_MAX, RELIC_MAX, STORY_MAX, MAX_STORY = 3000, 9500, 5000, 10
CAVERN = (("head", "Head"), ("hand", "Hand"), ("body", "Body"), ("feet", "Feet"))
PLANAR = (("planarsphere", "Planar Sphere"), ("linkrope", "Link Rope"))


def _entry(df: DataFrame, ident: Column, category: str, name: Column, subtitle: Column, url: Column, text: Column, flags: Column, *more: Column) -> DataFrame:
    return df.select(
        ident.alias("id"), F.lit(category).alias("category"), name.alias("name"), subtitle.alias("subtitle"), F.lit("wiki").alias("source_type"), url.alias("source_url"),
        text.alias("raw_text"), F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("string").alias("game_version_seen"), flags.alias("qa_flags"), F.lit(False).alias("reviewed"), *more,
    )


def light_cones(pages: DataFrame, base_url: str = "") -> DataFrame:
    """One entry per page: its ``Description`` template, cleaned; a page without one is flagged and has no text."""
    title, text = F.col("title"), F.col("wikitext")
    arg = template_arg(text, "Description")
    rows = pages.select(title, text, F.when(arg != "", arg).alias("_raw")).withColumn("_text", clean_text(F.col("_raw")))
    rarity, path = infobox_field(text, "rarity"), infobox_field(text, "effect_path")
    label = F.concat_ws(" · ", F.when(rarity.rlike(r"\A[0-9]+\z"), F.concat(rarity, F.lit("★ Light Cone"))).otherwise("Light Cone"), F.when(path != "", path))
    missing = F.col("_raw").isNull()
    flags = F.when(missing, F.array(F.lit("no_description_template"))).otherwise(length_flags(F.col("_text"), LIGHT_CONE_MAX))
    return _entry(rows, slug(title, "light-cone"), "light_cone", title, F.when(missing, "Light Cone").otherwise(label), page_url(title, base_url), F.coalesce("_text", F.lit("")), flags)


def relic_sets(sets: DataFrame, pages: DataFrame, base_url: str = "") -> DataFrame:
    """One entry per set: the descriptions of its piece pages, joined in piece order; a set whose piece page does not exist has
    ``error`` and no text."""
    title, text = F.col("title"), F.col("wikitext")
    head = F.coalesce(infobox_field(text, "head"), F.lit("")) != ""
    field = lambda pieces: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), infobox_field(text, f).alias("piece")) for i, (f, label) in enumerate(pieces)])
    parts = sets.select(title, text, head.alias("_cavern"), F.explode(F.when(head, field(CAVERN)).otherwise(field(PLANAR))).alias("_p"))
    found = parts.join(pages.select(F.col("title").alias("_pt"), F.col("wikitext").alias("_pw")), F.col("_p.piece") == F.col("_pt"), "left")
    body = section(F.col("_pw"), "Description")
    told = F.when(F.coalesce("_p.piece", F.lit("")) == "", F.concat(F.lit("missing_piece_field:"), "_p.label")).when(F.coalesce(body, F.lit("")) == "", F.concat(F.lit("missing_piece_description:"), "_p.label"))
    lost = (F.coalesce("_p.piece", F.lit("")) != "") & F.col("_pt").isNull()
    rows = found.groupBy("title").agg(
        F.array_sort(F.collect_list(F.struct("_p.i", told.alias("flag"), F.when(told.isNull(), clean_text(body)).alias("text")))).alias("_parts"), F.max_by("_p.piece", F.when(lost, -F.col("_p.i"))).alias("error"),
        F.first("_cavern").alias("_cavern"), F.first("wikitext").alias("wikitext"),
    ).withColumn("_text", F.array_join(F.transform("_parts", lambda p: p["text"]), " "))
    lore = F.col("_text")
    late = F.when(lore == "", F.array(F.lit("no_lore_text"))).otherwise(length_flags(lore, RELIC_MAX))
    digits = F.array_max(F.regexp_extract_all(infobox_field(text, "rarity"), F.lit("([0-9])"), 1))
    label = F.when(F.col("_cavern"), "Relic Set").otherwise("Planar Ornament")
    subtitle = F.when(digits.isNotNull(), F.concat(digits, F.lit("★ "), label)).otherwise(label)
    flags = F.concat(F.array_compact(F.transform("_parts", lambda p: p["flag"])), late)
    return _entry(rows, slug(title, "relic-set"), "relic_set", title, subtitle, page_url(title, base_url), lore, flags, F.col("error"))


def character_stories(lore_pages: DataFrame, base_url: str = "") -> DataFrame:
    """An entry per numbered story of a character (name, wikitext of its lore page); none without page or template."""
    name = F.col("name")
    params = template_params(F.col("wikitext"), "Character Story")
    numbered = lambda p: F.transform(F.sequence(F.lit(1), F.lit(MAX_STORY)), lambda i: F.struct(i.alias("i"), F.element_at(p, F.concat(F.lit("text"), i.cast("string"))).alias("text")))
    stories = bind(params, lambda p: F.filter(numbered(p), lambda s: F.coalesce(s["text"], F.lit("")) != ""))
    rows = lore_pages.filter(F.col("wikitext").contains("{{Character Story")).select(name, stories.alias("_s"))
    each = rows.select(name, F.size("_s").alias("_total"), F.posexplode("_s").alias("_at", "_story")).withColumn("_text", clean_text(F.col("_story.text")))
    index = F.col("_story.i")
    subtitle = F.format_string("Character Story %d of %d · %s", F.col("_at") + 1, F.col("_total"), name)
    return _entry(
        each, slug(name, "character-story", index), "character_story", F.format_string("%s — Story %d", name, index), subtitle,
        page_url(F.concat(name, F.lit("/Lore")), base_url), F.col("_text"), length_flags(F.col("_text"), STORY_MAX),
    )


BUILDERS: dict[str, Callable[..., DataFrame]] = {"light_cone": light_cones, "relic_set": relic_sets, "character_story": character_stories}


def register_builder(category: str, build: Callable[..., DataFrame]) -> None:
    """A new category is one function from pages to entries; ``plans.refresh`` runs those registered, in this order."""
    BUILDERS[category] = build


def positions(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds position and total of each row within its group, gaps closed."""
    w = Window.partitionBy(group)
    return df.withColumn("position", F.row_number().over(w.orderBy(order))).withColumn("total", F.count("*").over(w))
