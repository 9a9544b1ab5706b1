"""Path expressions: extensions, normal forms, exclusion, relative and display paths, path tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.config import ScanConfig, normal_path

EXECUTABLE_UPLOAD = ("php", "php5", "php7", "phtml")


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def lowered(path: Column) -> Column:
    return F.lower(slashed(path))


def basename(path: Column) -> Column:
    return F.regexp_extract(slashed(path), "([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the base name, '' without one."""
    return F.lower(F.regexp_extract(basename(path), "\\.([^.]*)$", 1))


def excluded(path: Column, prefixes: list[str] | tuple[str, ...]) -> Column:
    """Equal to an excluded path or below it, by whole segments, in lower case."""
    p = F.rtrim(lowered(path), F.lit("/"))
    out = F.lit(False)
    for e in (normal_path(x) for x in prefixes):
        if e:
            out = out | (p == e) | p.startswith(e + "/")
    return out


def allowed(path: Column, config: ScanConfig) -> Column:
    return ~excluded(path, config.exclude_paths) & extension(path).isin(config.allowed_extensions())


def in_roots(path: Column, config: ScanConfig) -> Column:
    p = lowered(path)
    out = F.lit(False)
    for r in map(normal_path, config.roots()):
        out = out | (p == r) | p.startswith(r + "/")
    return out


def relative(path: Column, document_root: str, scan_paths: tuple[str, ...] = ()) -> Column:
    """Without the document root, else without a scan path, else as it is."""
    p = slashed(path)
    out = p
    for root in [*reversed([s.replace("\\", "/").rstrip("/") for s in scan_paths]), document_root.replace("\\", "/").rstrip("/")]:
        if root:
            out = F.when(F.startswith(p, F.lit(root + "/")), F.substring(p, len(root) + 1, 1 << 30)).otherwise(out)
    return out


def display(path: Column, document_root: str, mode: str) -> Column:
    root = document_root.rstrip("/")
    if mode != "relative" or not root:
        return path
    return F.when(F.startswith(F.lower(path), F.lit(root.lower() + "/")), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def is_binary(content: Column) -> Column:
    """By the first eight bytes; empty content is not binary. Magic numbers."""
    magics = ["4D5A", "89504E47", "FFD8FF", "504B0304", "25504446", "52617221", "47494638", "7F454C46", "494433", "0000001866747970"]
    head = F.upper(F.hex(F.substring(content, 1, 8)))
    out = F.lit(False)
    for m in magics:
        out = out | head.startswith(m)
    return out


def path_tags(path: Column) -> Column:
    """Sorted distinct tags of a path (fixed values: segments and tags)."""
    p = F.concat(F.lit("/"), F.ltrim(lowered(path), F.lit("/")))
    has = lambda seg: p.contains(seg) | F.endswith(p, F.lit(seg.rstrip("/")))
    any_of = lambda *segs: F.greatest(*[has(s) for s in segs]) if len(segs) > 1 else has(segs[0])
    upload = has("/upload/")
    rules = {
        "entity:file": F.lit(True),
        "path:bitrix_module": has("/bitrix/modules/"),
        "path:local_module": has("/local/modules/"),
        "path:php_interface": any_of("/bitrix/php_interface/", "/local/php_interface/"),
        "path:upload": upload,
        "path:cache": has("/cache/"),
        "path:tmp": has("/tmp/"),
        "path:vendor": has("/vendor/"),
        "path:local": any_of("/local/components/", "/local/modules/", "/local/php_interface/", "/local/templates/"),
        "path:core": any_of("/bitrix/modules/", "/bitrix/admin/", "/bitrix/tools/", "/bitrix/php_interface/") & ~p.contains("/bitrix/cache/") & ~p.contains("/bitrix/tmp/"),
        "path:hidden": p.rlike("/\\.[^/]"),
        "risk:executable_upload": upload & extension(path).isin(*EXECUTABLE_UPLOAD),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(c, t) for t, c in rules.items()])))
