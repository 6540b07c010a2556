"""Links between documents: parsing, and resolution by preference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def note_key(path: Column) -> Column:
    """A path in lower case without its .md ending."""
    return F.regexp_replace(F.lower(path), r"\.md$", "")


def stem(path: Column) -> Column:
    return F.regexp_extract(note_key(path), r"([^/]*)$", 1)


def hrefs(html: Column) -> Column:
    """Targets of anchors in order; scheme URLs, bare anchors and climbs above the root are no links."""
    all_ = F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*href=["']([^"'#]*)"""), F.lit(1))
    return F.filter(all_, lambda t: (t != "") & ~t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~t.startswith(".."))


def resolved(links: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk, position, document, path: the best document for each link (source, chunk, position, kind, key, linker).

    Documents are (source, document, path, kind). A wikilink or related link
    with a folder in its key means the note of that path, else one below the
    linker's folder whose path ends so, else any that does; a bare one a note
    of that name below the linker's folder, else anywhere. A path link means
    that path; an import that module, else one whose dotted name ends so. Of
    several, notes come before other files (but for imports), then shorter
    paths, then paths in order. A link whose best document is its own has
    none; sources never mix. Every tail of a path is a key, so all is found by
    equal joins and no two paths are compared.
    """
    note, module = F.split(note_key(F.col("path")), "/"), F.split(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/")
    tails = lambda parts, kind: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.lit(kind).alias("space"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/").alias("key"), (n == F.size(parts)).alias("whole")))
    path = F.array(F.struct(F.lit("path").alias("space"), F.col("path").alias("key"), F.lit(True).alias("whole")))
    keys = F.concat(tails(note, "note"), path, F.when(F.col("kind") == "python", tails(module, "module")).otherwise(F.slice(path, 1, 0)))
    docs = documents.select("source", "document", F.col("path").alias("to"), (F.col("kind") == "markdown").alias("note"), F.explode(keys).alias("k")).select("source", "document", "to", "note", "k.*")
    home = documents.select("source", F.col("document").alias("linker"), F.regexp_extract(note_key(F.col("path")), "^(.*/)?", 0).alias("folder"))
    space = F.when(F.col("kind") == "markdown", "path").when(F.col("kind") == "import", "module").otherwise("note")
    key = F.when(F.col("kind") == "import", F.replace("key", F.lit("."), F.lit("/"))).otherwise(F.col("key"))
    asked = links.select("source", "chunk", "position", "linker", space.alias("space"), key.alias("key")).join(home, ["source", "linker"], "left")
    exact = (F.col("space") != "note") | F.col("key").contains("/")
    # per key only what may be the best leaves a task: of whole paths, of each folder above a document, and of all; a key that all documents share is one row then
    better = F.min(F.struct((~(F.col("note") & (F.col("space") != "module"))).alias("other"), F.length("to").alias("size"), "to", "document")).alias("best")
    above = F.filter(F.transform(F.sequence(F.lit(0), F.length("to")), lambda n: F.left(F.lower("to"), n)), lambda x: (x == "") | x.endswith("/"))
    whole = docs.where(F.col("whole") & exact).withColumn("tier", F.lit(0)).withColumn("folder", F.lit(""))
    near = docs.where("space = 'note'").withColumn("tier", F.lit(1)).withColumn("folder", F.explode(above))
    every = docs.withColumn("tier", F.lit(2)).withColumn("folder", F.lit(""))
    by = ["source", "space", "key", "tier", "folder"]
    firsts = reduce(DataFrame.unionByName, (x.select(*by, "note", "to", "document") for x in (whole, near, every))).groupBy(*by).agg(better)
    tiers = F.array(F.struct(F.lit(0).alias("tier"), F.lit("").alias("folder")), F.struct(F.lit(1).alias("tier"), F.coalesce("folder", F.lit("")).alias("folder")), F.struct(F.lit(2).alias("tier"), F.lit("").alias("folder")))
    wanted = asked.select("source", "space", "key", "chunk", "position", "linker", F.explode(tiers).alias("t")).select("source", "space", "key", "chunk", "position", "linker", "t.*")
    found = wanted.join(firsts, by).groupBy("chunk", "position").agg(F.min(F.struct("tier", "best", "linker")).alias("x"))
    return found.where("x.best.document <> x.linker").select("chunk", "position", F.col("x.best.document").alias("document"), F.col("x.best.to").alias("path"))
