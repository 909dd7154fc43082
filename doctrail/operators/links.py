"""Files of a vault, the links of its notes, and the naming of artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTACHMENT = r"(?i)\.(?:png|jpe?g|gif|svg|webp|bmp|pdf|mp3|m4a|wav|mp4|webm|mov|csv|xlsx?|docx?|pptx?|zip)$"
LINK = r"(!?)\[\[([^\]|#]*)(#[^\]|]*)?(?:\|([^\]]*))?\]\]"


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def file_index(paths: DataFrame) -> DataFrame:
    """rel_path, rel_lc, name_lc, stem_lc, is_attachment of paths (rel_path)."""
    name = F.element_at(F.split("rel_path", "/"), -1)
    return paths.select("rel_path", F.lower("rel_path").alias("rel_lc"), F.lower(name).alias("name_lc"), F.lower(_stem(F.col("rel_path"))).alias("stem_lc"), (name.rlike(ATTACHMENT) | F.lower("rel_path").rlike(r"(^|/)attachments?/")).alias("is_attachment"))


def wikilinks(notes: DataFrame) -> DataFrame:
    """doc_id, pos, embed, target, anchor, alias of the [[links]] of notes (doc_id, text)."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(r"!?\[\[[^\]]+\]\]"), F.lit(0))).alias("pos", "raw")
    part = lambda k: F.regexp_extract("raw", LINK, k)
    return notes.select("doc_id", found).select("doc_id", "pos", (part(1) == "!").alias("embed"), F.trim(part(2)).alias("target"), F.nullif(part(3), F.lit("")).alias("anchor"), F.nullif(part(4), F.lit("")).alias("alias"))


def resolve_targets(links: DataFrame, index: DataFrame) -> DataFrame:
    """The links with ``rel_path``: the file of the same path, with .md, below notes, else of the name or stem; attachments first.

    Every target gives a few ranked keys, which join the keys of the files; the
    best rank wins, then attachments, then the shorter and smaller path.
    """
    t = F.lower(F.trim("target"))
    keys = F.array(t, F.concat(t, F.lit(".md")), F.concat(F.lit("notes/"), t), F.concat(F.lit("notes/"), t, F.lit(".md")), F.element_at(F.split(t, "/"), -1), _stem(t))
    kinds = F.array(*[F.lit(x) for x in ("rel", "rel", "rel", "rel", "name", "stem")])
    asked = links.select("target").distinct().select("target", F.posexplode(F.arrays_zip(kinds.alias("kind"), keys.alias("key"))).alias("rank", "k")).select("target", "rank", "k.kind", "k.key")
    known = index.select("rel_path", "rel_lc", "is_attachment", F.explode(F.array(F.struct(F.lit("rel").alias("kind"), F.col("rel_lc").alias("key")), F.struct(F.lit("name").alias("kind"), F.col("name_lc").alias("key")), F.struct(F.lit("stem").alias("kind"), F.col("stem_lc").alias("key")))).alias("k")).select("rel_path", "rel_lc", "is_attachment", "k.*")
    # Files in an attachments folder go before those of the same name elsewhere.
    order = F.struct("rank", (~F.col("rel_lc").rlike(r"(^|/)attachments?/")).alias("elsewhere"), (~F.col("is_attachment")).alias("note"), F.length("rel_path").alias("n"), "rel_path")
    best = asked.join(known, ["kind", "key"]).groupBy("target").agg(F.min(order).alias("best")).select("target", "best.rel_path")
    return links.join(best, "target", "left")


def link_markdown(alias: Column, target: Column, anchor: Column, path: Column, embed: Column, base: str) -> Column:
    """A link as Markdown: to the file found, its path URL-coded, else its label alone."""
    label = F.coalesce(alias, F.concat(target, F.coalesce(anchor, F.lit(""))))
    coded = F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    link = F.concat(F.when(embed, "!").otherwise(""), F.lit("["), label, F.lit(f"]({base}"), coded, F.lit(")"))
    return F.when(path.isNull(), label).otherwise(link)


def rewrite_links(notes: DataFrame, index: DataFrame, base: str = "file:///") -> DataFrame:
    """doc_id, text: notes (doc_id, text; ids unique) with their wikilinks written as Markdown."""
    found = resolve_targets(wikilinks(notes), index)
    written = found.select("doc_id", F.struct("pos", link_markdown(F.col("alias"), F.col("target"), F.col("anchor"), F.col("rel_path"), F.col("embed"), base).alias("md")).alias("l"))
    lists = written.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["md"]).alias("links"))
    between = F.split("text", r"!?\[\[[^\]]+\]\]", -1)
    joined = F.array_join(F.zip_with(between, F.coalesce("links", F.array().cast("array<string>")), lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")
    return notes.join(lists, "doc_id", "left").select("doc_id", joined.alias("text"))


def artifact_names(targets: DataFrame) -> DataFrame:
    """target, artifact: the name of each target's artefact, with the parent folder where two targets share a name."""
    name = _stem(F.col("target"))
    shared = F.count("*").over(Window.partitionBy(F.lower(name))) > 1
    parts = F.split("target", "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    return targets.select("target", F.concat(F.lit("🤖 "), name, F.when(shared & (parent != ""), F.concat(F.lit(" ("), parent, F.lit(")"))).otherwise(""), F.lit(".md")).alias("artifact"))


def image_names(images: DataFrame) -> DataFrame:
    """path, versioned: names with the first eight digits of the content's MD5, for images (path, content)."""
    name = F.element_at(F.split("path", "/"), -1)
    return images.select("path", F.concat(_stem(F.col("path")), F.lit("_"), F.substring(F.md5("content"), 1, 8), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)).alias("versioned"))


def companion_pdf(targets: DataFrame, index: DataFrame) -> DataFrame:
    """target, pdf: the compiled file of a source: of the same stem next to it, in its folder's parents, then any paper/main.pdf above; newest of the best.

    ``index`` has rel_path and mtime.
    """
    pdfs = index.where(F.lower("rel_path").endswith(".pdf")).select("rel_path", "mtime", F.lower(_stem(F.col("rel_path"))).alias("stem"), F.regexp_replace("rel_path", r"/?[^/]*$", "").alias("folder"))
    up = lambda n: F.regexp_replace("target", r"/?[^/]*$" if n == 0 else r"(?:/?[^/]*){%d}$" % (n + 1), "")
    stem = F.lower(_stem(F.col("target")))
    tries = [F.struct(F.lit(n).alias("rank"), up(n).alias("folder"), stem.alias("stem")) for n in range(4)]
    tries += [F.struct(F.lit(4 + n).alias("rank"), F.concat_ws("/", F.nullif(up(n), F.lit("")), F.lit("paper")).alias("folder"), F.lit("main").alias("stem")) for n in range(4)]
    asked = targets.select("target", F.explode(F.array(*tries)).alias("t")).select("target", "t.*")
    met = asked.join(pdfs, ["folder", "stem"])
    best = F.min(F.struct("rank", (-F.unix_micros("mtime")).alias("age"), "rel_path"))
    return targets.join(met.groupBy("target").agg(best.alias("b")).select("target", F.col("b.rel_path").alias("pdf")), "target", "left")
