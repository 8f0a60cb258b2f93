"""Path expressions. Paths use forward slashes; all are Catalyst expressions over strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """What stands before the last slash; empty if there is none."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Last suffix in lower case; empty for none, and for names whose only dot leads."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"([^/])\.[^./]*$", "$1")


def with_extension(path: Column, ext: Column) -> Column:
    return F.concat(without_extension(path), F.lit("."), ext)


def stem(path: Column) -> Column:
    return without_extension(file_name(path))


def join(directory: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(directory, "/$", ""), F.lit("/"), name)


def relative_to(path: Column, root: Column) -> Column:
    """Path below the root; null if it isn't."""
    base = F.concat(F.regexp_replace(root, "/$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path)))


def is_hidden(path: Column, root: Column) -> Column:
    """Whether any segment below the root begins with a dot."""
    return F.exists(F.split(relative_to(path, root), "/"), lambda x: x.startswith("."))


def is_glob(path: Column) -> Column:
    return path.contains("*") | path.contains("?") | (path.contains("[") & path.contains("]"))


def glob_prefix(path: Column) -> Column:
    """What stands before the first pattern character."""
    return F.regexp_extract(path, r"^[^*?\[]*", 0)


def glob_base(path: Column) -> Column:
    """Directory that a pattern starts from: the parent of its literal prefix, or ``.``."""
    prefix = glob_prefix(path)
    base = F.when(prefix.endswith("/"), F.regexp_replace(prefix, "/$", "")).otherwise(parent(prefix))
    return F.when(base == "", F.when(prefix.startswith("/"), "/").otherwise(".")).otherwise(base)


def target_extension(target: Column) -> Column:
    """Extension of a target's files; favicons are ``.ico`` files."""
    return F.when(target == "favicon", "ico").otherwise(target)


def single_output(path: Column, target: Column, output: Column, output_is_dir: Column, n_targets: Column) -> Column:
    """Output of one input file: in the output directory, at the output path (its extension swapped if there are several
    targets), or beside the input."""
    swapped = with_extension(file_name(path), target_extension(target))
    return (
        F.when(output.isNull(), with_extension(path, target_extension(target)))
        .when(output_is_dir, join(output, swapped))
        .when(n_targets > 1, with_extension(output, target_extension(target)))
        .otherwise(output)
    )


def batch_output(path: Column, root: Column, output_dir: Column, target: Column) -> Column:
    """Output in a batch: the path below the root put below the output directory, or beside the input."""
    ext = target_extension(target)
    return F.when(output_dir.isNull(), with_extension(path, ext)).otherwise(join(output_dir, with_extension(relative_to(path, root), ext)))


def page_output(path: Column, page: Column) -> Column:
    """Output of a page, counted from 1: ``{stem}_page_{n}.{ext}``, ``png`` where the path has no extension."""
    ext = F.when(extension(path) == "", "png").otherwise(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.concat(without_extension(path), F.lit("_page_"), page.cast("string"), F.lit("."), ext)


def package_paths(path: Column, is_dir: Column) -> Column:
    """Struct of a favicon package's directory and ``.ico`` name."""
    in_dir = is_dir | (extension(path) == "")
    directory = F.when(in_dir, path).when(parent(path) == "", ".").otherwise(parent(path))
    return F.struct(directory.alias("directory"), F.when(in_dir, "favicon.ico").otherwise(file_name(path)).alias("ico"))


def component_key(path: Column) -> Column:
    """Sort key that orders paths by their components, so that ``a/b`` comes before ``a-b``."""
    return F.split(path, "/")
