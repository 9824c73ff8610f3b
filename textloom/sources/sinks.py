"""Where chunks go: JSON, text, a folder of small files, plain rows for other libraries."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInputError


def chunk_json(chunks: DataFrame, metadata: bool = True) -> DataFrame:
    """A column json for each chunk: content, and all other columns under metadata if asked."""
    rest = [c for c in chunks.columns if c != "content"]
    fields = [F.col("content")] + ([F.struct(*rest).alias("metadata")] if metadata and rest else [])
    return chunks.select(F.to_json(F.struct(*fields)).alias("json"))


def rows(chunks: DataFrame) -> Iterator[dict[str, Any]]:
    """Chunks one by one as dictionaries, a partition at a time on the driver."""
    for r in chunks.toLocalIterator():
        d = r.asDict(True)
        yield {"content": d.pop("content"), "metadata": d}


def save_json(chunks: DataFrame, path: str, metadata: bool = True) -> None:
    """JSON lines in a folder, each partition written by its executor; nothing passes through the driver. For results of any size."""
    chunk_json(chunks, metadata).write.text(path)


def save_by_source(chunks: DataFrame, path: str, source: str = "source") -> None:
    """JSON lines in a folder for each source, written by the executors; a source's chunks may be in several files."""
    rest = [c for c in chunks.columns if c != "content"]
    chunks.select(F.col(source).alias("of"), F.to_json(F.struct("content", F.struct(*rest).alias("metadata"))).alias("json")).write.partitionBy("of").text(path)


def write_yaml(chunks: DataFrame, path: str, metadata: bool = False) -> int:
    """One YAML list on the driver's disk, a chunk at a time; gives their number. Needs PyYAML."""
    try:
        import yaml
    except ImportError as e:
        raise InvalidInputError("YAML needs PyYAML, which isn't installed") from e
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        for n, r in enumerate(rows(chunks), 1):
            item = json.loads(json.dumps(r if metadata else {"content": r["content"]}, default=str))
            out.write(yaml.safe_dump([item], allow_unicode=True, sort_keys=False))
        if not n:
            out.write("[]\n")
    return n


def write_json(chunks: DataFrame, path: str, metadata: bool = False) -> int:
    """One JSON array on the driver's disk, a chunk at a time; gives their number. For large results use chunk_json(...).write.text."""
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for r in rows(chunks):
            item = r if metadata else {"content": r["content"]}
            out.write((",\n" if n else "\n") + "    " + json.dumps(item, ensure_ascii=False, indent=4, default=str).replace("\n", "\n    "))
            n += 1
        out.write("\n]\n")
    return n


def write_text(chunks: DataFrame, out: TextIO, metadata: bool = False) -> int:
    """Numbered chunks as text."""
    n = 0
    for n, r in enumerate(rows(chunks), 1):
        out.write(f"--- Chunk {n} ---\n{r['content']}\n")
        if metadata:
            out.writelines(f"| {k}: {v}\n" for k, v in r["metadata"].items())
        out.write("\n")
    return n


def write_folder(chunks: DataFrame, folder: str, metadata: bool = False, source: str = "source") -> int:
    """<stem>_chunk_<n>.txt for each chunk, and the same with .json for its metadata; without a source the stem is stdin."""
    os.makedirs(folder, exist_ok=True)
    counts: dict[str, int] = {}
    for r in rows(chunks):
        stem = re.sub(r"[^\w.-]+", "_", os.path.splitext(os.path.basename(str(r["metadata"].get(source) or "stdin")))[0]) or "stdin"
        counts[stem] = counts.get(stem, 0) + 1
        base = os.path.join(folder, f"{stem}_chunk_{counts[stem]}")
        Path(f"{base}.txt").write_text(r["content"] or "", encoding="utf-8")
        if metadata:
            Path(f"{base}.json").write_text(json.dumps(r["metadata"], ensure_ascii=False, indent=4, default=str), encoding="utf-8")
    return sum(counts.values())


def as_pages(chunks: DataFrame) -> DataFrame:
    """page_content and metadata (a map of strings), as retrieval libraries take them."""
    rest = [c for c in chunks.columns if c != "content"]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string") if dict(chunks.dtypes)[c].split("<")[0] not in ("struct", "map", "array") else F.to_json(c))]
    return chunks.select(F.col("content").alias("page_content"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"))


def view(text: str, chunks: DataFrame, mode: str = "document") -> dict[str, Any]:
    """What a viewer of one text's chunks needs: the text, its chunks, statistics."""
    items = list(rows(chunks))
    return {"text": text, "chunks": items, "stats": {"text_length": len(text), "chunk_count": len(items), "mode": mode}}
