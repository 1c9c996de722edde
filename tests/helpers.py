"""Builders of small tables of the document model."""

from quirefold import schema


def blocks(spark, rows):
    """Rows of dicts with any columns of blocks; page 1 and running seq by default; `box` is (left, top, right, bottom)."""
    made = []
    for n, r in enumerate(rows):
        meta = r.get("meta")
        box = r.get("box")
        made.append(
            tuple(
                {
                    "doc_id": r.get("doc_id", 1),
                    "page": r.get("page", 1),
                    "seq": r.get("seq", n),
                    "block_id": r.get("block_id", f"b{n}"),
                    "bbox": box and tuple(map(float, box)),
                    "engine": r.get("engine", "test"),
                    "meta": meta and tuple(meta.get(f.name) for f in schema.META),
                }.get(f.name, r.get(f.name))
                for f in schema.BLOCKS
            )
        )
    return spark.createDataFrame(made, schema.BLOCKS)


def inspections(spark, pages, doc_id=1):
    """{page: native characters}."""
    return spark.createDataFrame([(doc_id, p, None, None, 0, n, 0, n == 0) for p, n in pages.items()], schema.PAGE_INSPECTIONS)
