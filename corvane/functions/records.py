"""Structs and maps that travel with answers: citations, payloads, prefixed items, metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.scores import effective_acl
from corvane.functions.text import collapse, preview

UNTITLED = "Untitled"
# The names under which raw hits carry the same thing, the first that is filled counts.
RAW = {
    "content": ("content_with_weight", "content", "text", "preview"),
    "title": ("docnm_kwd", "document_keyword", "document_name", "filename", "title"),
    "chunk_id": ("chunk_id", "id"),
    "document_id": ("doc_id", "document_id"),
    "title_path": ("title_path", "section_path"),
    "page": ("page", "page_num", "position"),
}
# Scores of raw hits.
RAW_SCORES = {"score": "similarity", "dense_score": "vector_similarity", "keyword_score": "term_similarity", "rerank_score": "rerank_score"}
SCORES = ("score", "dense_score", "keyword_score", "rerank_score")


def citation(
    chunk_id: Column, document_id: Column, title: Column, title_path: Column, content: Column, source_uri: Column, metadata: Column, page: Column, scores: dict[str, Column]
) -> Column:
    """The 13 fields of a citation; a score that is not given is null, a path that is empty the title."""
    none = F.lit(None).cast("double")
    path = F.when(F.coalesce(F.size(title_path), F.lit(0)) > 0, title_path).otherwise(F.array(title))
    return F.struct(
        chunk_id.cast("string").alias("chunk_id"), document_id.cast("string").alias("document_id"), title.alias("title"), path.alias("title_path"),
        *[scores.get(s, none).cast("double").alias(s) for s in SCORES],
        source_uri.alias("source_uri"), metadata.alias("metadata"), preview(content).alias("preview"), content.alias("content"), page.cast("string").alias("page"),
    )


def raw_hit(raw: Column) -> Column:
    """A raw hit's JSON object as a struct of strings; null where it is none."""
    names = sorted({n for names in RAW.values() for n in names} | set(RAW_SCORES.values()) | {"source_uri"})
    return F.from_json(raw, ", ".join(f"{n} string" for n in names))


def citation_from_raw(raw: Column) -> Column:
    """The citation of a raw hit (JSON text), whatever names its fields go by.

    Empty fields count as missing; a path may be a list or one text; ``metadata`` keeps the raw
    hit.  Text that is no JSON object gives a citation without content.
    """
    hit = raw_hit(raw)
    first = lambda *names: F.coalesce(*[F.nullif(hit[n], F.lit("")) for n in names])
    title = F.coalesce(first(*RAW["title"]), F.lit(UNTITLED))
    told = first(*RAW["title_path"])
    several = F.when(told.startswith("["), F.from_json(told, "array<string>")).when(told.isNotNull(), F.array(told))
    path = F.filter(F.coalesce(several, F.array().cast("array<string>")), lambda p: F.trim(p) != "")
    number = lambda n: hit[n].try_cast("double")
    scores = {s: number(n) for s, n in RAW_SCORES.items()} | {"score": F.coalesce(number(RAW_SCORES["score"]), F.lit(0.0))}
    page = F.coalesce(*[F.when(~hit[n].isin("", "0"), hit[n]) for n in RAW["page"]])
    return citation(
        F.coalesce(first(*RAW["chunk_id"]), F.lit("")), F.coalesce(first(*RAW["document_id"]), F.lit("")), title, path, collapse(first(*RAW["content"])),
        hit["source_uri"], F.create_map(F.lit("raw"), raw), page, scores,
    )


def chunk_payload(
    collection_id: Column, document_id: Column, chunk_id: Column, title: Column, filename: Column, acl: Column, project: Column, meeting_date: Column, title_path: Column
) -> Column:
    """What is stored beside a chunk's vector; without readers everybody is one."""
    return F.struct(
        collection_id.alias("collection_id"), document_id.alias("document_id"), chunk_id.alias("chunk_id"), title.alias("title"), filename.alias("filename"),
        effective_acl(acl).alias("acl"), project.alias("project"), meeting_date.alias("meeting_date"), title_path.alias("title_path"),
    )


def prefix_items(author: Column, project: Column, title: Column, items: Column) -> Column:
    """Each item after the first of author, project and title that is filled."""
    who = F.coalesce(F.nullif(author, F.lit("")), F.nullif(project, F.lit("")), title)
    return F.transform(items, lambda i: F.concat(who, F.lit(": "), i))


def merge_metadata(old: Column, new: Column) -> Column:
    """Both maps' entries, the new one's where a key is in both, whatever the session's policy; a null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def source_uri_for_zip(archive: Column, name: Column) -> Column:
    return F.concat(F.lit("zip://"), archive, F.lit("/"), name)


def object_key(collection_id: Column, document_id: Column, filename: Column) -> Column:
    """Where a document's bytes lie: its collection's folder, its id and its name."""
    return F.concat(collection_id, F.lit("/"), document_id.cast("string"), F.lit("-"), filename)
