"""Copies of the smallest tables that hold what dirty data holds: no rows, or nulls, repeated rows and columns with clashing names."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

DATA = "/root/testdata/sf0.001"
CLASHING = ("id", "doc", "valor", "n", "texto", "doc_id", "nivel", "posicion", "__text", "__n", "tokens", "campo", "clave", "k", "m", "s", "peso")


def write(folder: str, kind: str) -> str:
    """``kind``: "empty" or "dirty"; returns the folder."""
    for name in sorted(os.listdir(DATA)):
        table = pq.read_table(f"{DATA}/{name}")
        if kind == "empty":
            table = table.slice(0, 0)
        else:
            columns = {}
            for i, c in enumerate(table.column_names):
                values = table[c].to_pylist()
                columns[c] = pa.array([None if (r * 7 + i * 3) % 11 == 0 else v for r, v in enumerate(values)], table.schema.field(c).type)
            table = pa.table(columns)
            table = pa.concat_tables([table, table.slice(0, 20)])
            for c in CLASHING:
                if c not in table.column_names:
                    table = table.append_column(c, pa.array(["x"] * table.num_rows))
        pq.write_table(table, f"{folder}/{name}")
    return folder
