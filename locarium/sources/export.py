"""A small result as one compact JSON document and its script twin."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_document(tables: dict[str, tuple[DataFrame, str]], meta: dict, folder: Path | str, name: str, most_bytes: int = 1_000_000) -> int:
    """Write ``<name>.json`` and ``<name>.js`` into ``folder``; the document's size in bytes.

    ``tables`` holds a table and its order for each field. Keys are sorted and
    white space left out. Sizes are summed in Spark before anything comes to
    the driver: a document above ``most_bytes`` is an error and writes nothing.
    Files are replaced as a whole.
    """
    size, texts = 0, {}
    for field, (df, order) in tables.items():
        text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        rows = df.select(F.col(order).alias("by"), text.alias("row"))
        size += rows.agg(F.coalesce(F.sum(F.octet_length("row") + 1), F.lit(0))).first()[0]
        if size > most_bytes:
            raise ValueError(f"the document has more than {most_bytes} bytes")
        texts[field] = rows.orderBy("by")
    fields = [f"{json.dumps(f)}:[{','.join(r['row'] for r in df.collect())}]" for f, df in texts.items()]
    fields.append(f'"meta":{json.dumps(meta, sort_keys=True, separators=(",", ":"), ensure_ascii=False)}')
    document = "{" + ",".join(sorted(fields)) + "}"
    if len(document.encode()) > most_bytes:
        raise ValueError(f"the document has more than {most_bytes} bytes")
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    for suffix, text in (("json", document), ("js", f"window.{name}={document};\n")):
        draft = folder / f".{name}.{suffix}.part"
        draft.write_text(text, encoding="utf-8")
        os.replace(draft, folder / f"{name}.{suffix}")
    return len(document.encode())
