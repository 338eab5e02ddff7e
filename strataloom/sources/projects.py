"""A corpus of small source files, one for each document, whose facts follow from the document's id.

File i imports, calls and names the types of file i + 6, which is written in the same language; so
extraction, resolution, expansion and the joins over facts run over a table of any size, and plain
SQL can say what they must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import base_priority, file_type
from ..operators.resolve import Project
from .tables import table

#: Path and text by the id's remainder by six; %i is the id, %j the id of the file that it uses.
TEMPLATES = (
    ("py/m%i.py", "import os\nfrom py.m%j import M%j, helper%j\n\nclass M%i(M%j):\n    def run(self, x: M%j) -> int:\n        return helper%j(x)\n\ndef helper%i(x):\n    return os.getpid()\n\ndef _hidden%i():\n    pass\n"),
    ("src/m%i.rs", "use crate::m%j::{M%j, helper%j};\nuse std::fmt;\n\npub struct M%i;\n\npub fn helper%i(x: M%j) -> u32 {\n    m%j::helper%j(x)\n}\n\nfn hidden%i() {\n    helper%i(M%j);\n}\n"),
    ("web/m%i.ts", "import { M%j, helper%j } from './m%j';\nimport * as fs from 'fs';\n\nexport interface M%i { id: string }\n\nexport function helper%i(x: M%j): M%j {\n  return helper%j(x);\n}\n"),
    ("go/p%i/m%i.go", 'package p%i\n\nimport (\n\t"fmt"\n\tq "example.org/app/go/p%j"\n)\n\ntype M%i struct{}\n\nfunc Helper%i(x q.M%j) {\n\tfmt.Println(q.Helper%j(x))\n}\n'),
    ("web/j%i.js", "const dep = require('./j%j');\n\nfunction helper%i(x) {\n  return dep.helper%j(x);\n}\n\nexports.helper%i = helper%i;\n"),
    ("Sources/T%i/m%i.swift", "import Foundation\nimport T%j\n\npublic struct M%i {\n    func run(x: M%j) -> Int {\n        return helper%j(x)\n    }\n}\n"),
)

PROJECT = Project(go_module="example.org/app")

#: The same paths in SQL.
PATHS = """f AS (SELECT doc_id AS i, (doc_id % 6)::INTEGER AS k, CASE doc_id % 6 WHEN 0 THEN 'py/m' || doc_id || '.py' WHEN 1 THEN 'src/m' || doc_id || '.rs' WHEN 2 THEN 'web/m' || doc_id || '.ts'
  WHEN 3 THEN 'go/p' || doc_id || '/m' || doc_id || '.go' WHEN 4 THEN 'web/j' || doc_id || '.js' ELSE 'Sources/T' || doc_id || '/m' || doc_id || '.swift' END AS path FROM (SELECT DISTINCT doc_id FROM documents))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FILES columns and doc_id."""
    i = F.col("doc_id").cast("string")
    j = (F.col("doc_id") + 6).cast("string")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("%i"), i), F.lit("%j"), j)
    path = content = F.lit(None).cast("string")
    for k, (p, text) in enumerate(TEMPLATES):
        mine = F.col("doc_id") % 6 == k
        path, content = F.when(mine, fill(p)).otherwise(path), F.when(mine, fill(text)).otherwise(content)
    out = table(spark, sf_dir, "documents").select("doc_id").distinct().select("doc_id", path.alias("relative_path"), content.alias("content"))
    out = out.withColumns({"path": F.col("relative_path"), "size": F.octet_length("content").cast("bigint"), "error": F.lit(None).cast("string"), "file_type": file_type(F.col("relative_path"))})
    return out.withColumn("priority", base_priority(F.col("file_type"), F.col("relative_path")))
