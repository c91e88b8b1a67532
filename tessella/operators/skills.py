"""A catalog of skills from two sources (user, project): rows (source, name, category, description, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import valid_name


def allowed_tools(raw: Column) -> Column:
    """A list of tools from a JSON list or from names with commas."""
    as_json = F.from_json(raw, "array<string>")
    bare = F.when(raw.startswith("["), F.regexp_replace(raw, r"^\[+|\]+$", "")).otherwise(raw)
    names = F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(raw.startswith("[") & as_json.isNotNull(), as_json).when(raw.isNotNull(), names)


def valid(skills: DataFrame) -> DataFrame:
    """Skills with a proper name that are not switched off."""
    return skills.where(valid_name(F.col("name")) & (F.lower(F.coalesce(F.col("enabled"), F.lit("true"))) != "false"))


def conflicts(skills: DataFrame) -> DataFrame:
    """(name) that one source has more than once, unless a project has it once over ambiguous user skills."""
    n = skills.groupBy("name").agg(F.count(F.when(F.col("source") == "user", 1)).alias("u"), F.count(F.when(F.col("source") == "project", 1)).alias("p"))
    return n.where("p > 1 or (u > 1 and p = 0)").select("name")


def resolved(skills: DataFrame) -> DataFrame:
    """One skill per name, the project's before the user's; names in conflict are left out."""
    rest = [c for c in skills.columns if c not in ("name", "source")]
    by = skills.groupBy("name").agg(
        F.count(F.when(F.col("source") == "user", 1)).alias("u"), F.count(F.when(F.col("source") == "project", 1)).alias("p"),
        F.min_by(F.struct("source", *rest), F.when(F.col("source") == "project", 0).otherwise(1)).alias("s"),
    )
    return by.where("p = 1 or (p = 0 and u = 1)").select("name", "s.*")


def catalog(skills: DataFrame, category: str | None = None, allowed: list[str] | None = None) -> DataFrame:
    rows = resolved(skills)
    rows = rows if category is None else rows.where(F.col("category") == category)
    rows = rows if allowed is None else rows.where(F.col("name").isin(allowed))
    return rows.orderBy(F.coalesce("category", F.lit("")), "name")


def find(skills: DataFrame, name: str, suggestions: int = 20) -> tuple[DataFrame, str | None, list[str]]:
    """(rows, error, suggestions) for a name."""
    hit = resolved(skills).where(F.col("name") == name)
    if hit.limit(1).count():
        return hit, None, []
    if conflicts(skills).where(F.col("name") == name).limit(1).count():
        return hit, "ambiguous", []
    return hit, "not_found", [r.name for r in catalog(skills).select("name").limit(suggestions).collect()]


def unknown_tools(requested: Column, known: Column) -> Column:
    return F.array_except(requested, known)


def patch(content: Column, old: Column, new: Column, replace_all: Column) -> Column:
    """content with old replaced; null unless old occurs once, or replace_all is set and it occurs."""
    times = (F.length(content) - F.length(F.replace(content, old, F.lit("")))) / F.length(old)
    return F.when((F.length(old) > 0) & ((times == 1) | (replace_all & (times > 1))), F.replace(content, old, new))


def _folded(base: DataFrame, changes: DataFrame, key: list[str], empties: Column, step) -> DataFrame:
    """(key, content) after the changes of each key in order of (at, seq): step(content, change) is the content after a change.

    Only what follows the last change that certainly empties or fills a key (empties) is folded, with that change itself, so
    a fold holds what was changed since then and no more.
    """
    fields = [F.col(c) if c in changes.columns else F.lit(None).cast("boolean" if c == "replace_all" else "string").alias(c) for c in ("action", "content", "old", "new", "replace_all")]
    rows = changes.select(*key, "at", (F.col("seq") if "seq" in changes.columns else F.lit(0)).cast("long").alias("seq"), *fields)
    last = rows.where(empties).groupBy(*key).agg(F.max(F.struct("at", "seq")).alias("from"))
    rows = rows.join(last, key, "left").where(F.col("from").isNull() | (F.struct("at", "seq") >= F.col("from"))).drop("from")
    each = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "seq", "action", "content", "old", "new", "replace_all"))).alias("c"))
    met = base.join(each, key, "full_outer")
    return met.withColumn("content", F.when(F.col("c").isNull(), F.col("content")).otherwise(F.aggregate("c", F.col("content"), step))).drop("c").where(F.col("content").isNotNull())


def _patched(content: Column, c: Column) -> Column:
    return F.coalesce(patch(content, c["old"], c["new"], F.coalesce(c["replace_all"], F.lit(False))), content)


def apply_changes(skills: DataFrame, changes: DataFrame) -> DataFrame:
    """skills after the changes (source, name, at, action, content, old, new, replace_all; seq orders those of one time), one
    after the other: create and edit set content, patch() replaces in it, delete removes. A create of what exists and an
    edit, patch or delete of what does not are left out."""

    def step(content: Column, c: Column) -> Column:
        there = content.isNotNull()
        return (
            F.when(there & (c["action"] == "delete"), F.lit(None).cast("string")).when(there & (c["action"] == "edit"), F.coalesce(c["content"], content))
            .when(there & (c["action"] == "patch"), _patched(content, c)).when(~there & (c["action"] == "create"), c["content"]).otherwise(content)
        )

    return _folded(skills, changes, ["source", "name"], F.col("action") == "delete", step)


#: Folders beside a skill whose files can be written.
FILE_FOLDERS = ("references", "templates", "scripts", "assets")


def apply_file_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files (source, name, path, content) after the changes (at, seq, action: write_file, patch, remove_file, content,
    old, new, replace_all) of each, one after the other. Paths outside FILE_FOLDERS, removals and patches of what is not there, and patches that do
    not fit (patch()) are left out."""
    key = ["source", "name", "path"]
    inside = F.split("path", "/")[0].isin(*FILE_FOLDERS) & ~F.col("path").rlike(r"(^|/)\.\.?(/|$)|//|^/|/$")

    def step(content: Column, c: Column) -> Column:
        return (
            F.when(c["action"] == "write_file", F.coalesce(c["content"], content)).when(c["action"] == "remove_file", F.lit(None).cast("string"))
            .when(content.isNotNull() & (c["action"] == "patch"), _patched(content, c)).otherwise(content)
        )

    whole = (F.col("action") == "remove_file") | (F.col("action") == "write_file") & F.col("content").isNotNull()
    return _folded(files, changes.where(inside), key, whole, step).select(*key, "content")


def may_write(read_digest: Column, current: Column, owner: Column, agent: str = "agent") -> Column:
    """A background writer owns the file and has read it as it is."""
    return (owner == agent) & (read_digest == F.sha2(current, 256))


def signature(files: DataFrame) -> DataFrame:
    """One hash of a listing (path, size, digest), whatever its order."""
    rows = files.agg(F.sort_array(F.collect_list(F.concat_ws("|", "path", F.col("size").cast("string"), "digest"))).alias("l"))
    return rows.select(F.sha2(F.array_join("l", "\n"), 256).alias("signature"))


def prompt_index(skills: DataFrame) -> DataFrame:
    """The catalog as one text, a line for each skill."""
    lines = F.sort_array(F.collect_list(F.struct(F.coalesce("category", F.lit("")).alias("c"), "name", F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce("description", F.lit(""))).alias("line"))))
    return resolved(skills).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def linked_files(files: DataFrame, folder: str, kinds: tuple[str, ...] = ("references", "templates", "scripts", "assets")) -> DataFrame:
    """(kind, files) beside a skill: paths below folder, by the first folder of the path."""
    inside = files.where(F.col("path").startswith(folder.rstrip("/") + "/")).select(F.substring(F.col("path"), F.lit(len(folder.rstrip("/")) + 2), F.length("path")).alias("path"))
    rows = inside.withColumn("kind", F.split("path", "/")[0]).where(F.col("kind").isin(*kinds))
    return rows.groupBy("kind").agg(F.sort_array(F.collect_list("path")).alias("files"))


def rendered(template: Column, arguments: Column, folder: Column, folder_variable: str = "${SKILL_DIR}") -> Column:
    """A template with its arguments and its folder put in."""
    filled = F.replace(F.replace(template, F.lit("${ARGUMENTS}"), arguments), F.lit("$ARGUMENTS"), arguments)
    return F.replace(filled, F.lit(folder_variable), folder)
