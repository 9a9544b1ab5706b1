"""Scan configuration: profiles, thresholds, option normalization and validation."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

# Extensions of the profiles, thresholds, quick roots.
STANDARD_EXTENSIONS = "php js phtml module include phtm cgi pl py sh php3 php4 php5 php6 php7 php8 pht shtml html htm tpl inc css".split()
DEEP_EXTENSIONS = STANDARD_EXTENSIONS + "txt sql svg htaccess susp suspected infected vir o so".split()
AST_EXTENSIONS = "php php5 php7 phtml module include".split()
THRESHOLDS = {"balanced": (4, 8), "strict": (3, 6), "paranoid": (2, 5)}
QUICK_ROOTS = ("/upload", "/bitrix/php_interface", "/local/php_interface", "/local/modules")
SCAN_PROFILES = ("quick", "standard", "deep")
ACTIONS = ("report", "quarantine", "delete")
DEFAULT_EXCLUDES = ("/bitrix/cache", "/bitrix/managed_cache", "/bitrix/stack_cache", "/upload/resize_cache")


class ConfigError(ValueError):
    """A usage error; its text is a code such as ``cli_invalid_value:profile``."""


def truthy(value) -> bool:
    """True only for true, 'Y', '1' and 1."""
    return value is True or value in ("Y", "1") or (isinstance(value, int) and not isinstance(value, bool) and value == 1)


def clamp_int(value, low: int, high: int, default: int | None = None) -> int:
    try:
        n = int(float(str(value).strip().replace(",", ".")))
    except (ValueError, OverflowError):
        n = low if default is None else default
    return min(high, max(low, n))


def clamp_float(value, low: float, high: float, default: float | None = None) -> float:
    try:
        x = float(str(value).strip().replace(",", "."))
    except ValueError:
        x = low if default is None else default
    return min(high, max(low, x))


def line_list(value, document_root: str = "") -> list[str]:
    """Lines or items, trimmed, without blanks and repeats, ``#DOCUMENT_ROOT#`` expanded."""
    items = re.split(r"[\r\n]+", value) if isinstance(value, str) else list(value or [])
    out = [str(x).strip().replace("#DOCUMENT_ROOT#", document_root.rstrip("/")) for x in items]
    return list(dict.fromkeys(x for x in out if x))


def extension_list(value) -> list[str]:
    items = re.split(r"[\s,;]+", value) if isinstance(value, str) else list(value or [])
    return list(dict.fromkeys(x for x in (str(i).strip().lower().lstrip(".") for i in items) if x))


def normal_path(path: str) -> str:
    return path.replace("\\", "/").rstrip("/").lower()


@dataclass(frozen=True)
class ScanConfig:
    document_root: str = ""
    scan_paths: tuple[str, ...] = ()
    scan_profile: str = "standard"
    profile: str = "balanced"
    action: str = "report"
    dry_run: bool = True
    batch_size: int = 50
    max_file_mb: int = 100
    exclude_paths: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    prefilter: bool = True
    normalized_hash: bool = True
    normalized_hash_max_mb: int = 5
    ast: bool = True
    ast_max_bytes: int = 1_048_576
    entropy: bool = False
    entropy_deep: bool = True
    entropy_off: bool = False
    entropy_min_length: int = 200
    entropy_threshold: float = 4.7
    entropy_window: int = 300
    urls: bool = True
    hash_db: bool = True
    prefix_length: int = 8
    scan_agents: bool = False
    scan_events: bool = False
    resolve_handlers: bool = True

    @classmethod
    def of(cls, **options) -> ScanConfig:
        """Normalize options; unknown names and values out of an enumeration are usage errors."""
        known = cls.__dataclass_fields__
        for name in options:
            if name not in known:
                raise ConfigError(f"cli_unknown_option:{name}")
        got = dict(options)
        for name, allowed in (("scan_profile", SCAN_PROFILES), ("profile", tuple(THRESHOLDS)), ("action", ACTIONS)):
            if name in got and got[name] not in allowed:
                raise ConfigError(f"cli_invalid_value:{name}")
        root = str(got.get("document_root", "")).rstrip("/")
        for name, low, high in (("batch_size", 1, 1000), ("max_file_mb", 1, 1024), ("normalized_hash_max_mb", 1, 1024), ("prefix_length", 8, 12), ("entropy_min_length", 1, 1_000_000), ("entropy_window", 0, 1_000_000), ("ast_max_bytes", 1, 1 << 30)):
            if name in got:
                got[name] = clamp_int(got[name], low, high, known[name].default)
        if "entropy_threshold" in got:
            got["entropy_threshold"] = clamp_float(got["entropy_threshold"], 0.0, 8.0, 4.7)
        for name in ("dry_run", "prefilter", "normalized_hash", "ast", "entropy", "entropy_deep", "entropy_off", "urls", "hash_db", "scan_agents", "scan_events", "resolve_handlers"):
            if name in got:
                got[name] = truthy(got[name])
        for name in ("scan_paths", "exclude_paths"):
            if name in got:
                got[name] = tuple(line_list(got[name], root))
        if "extensions" in got:
            got["extensions"] = tuple(extension_list(got["extensions"]))
        return cls(**(got | {"document_root": root}))

    @property
    def thresholds(self) -> tuple[int, int]:
        return THRESHOLDS[self.profile]

    def allowed_extensions(self) -> list[str]:
        return list(self.extensions) or (DEEP_EXTENSIONS if self.scan_profile == "deep" else STANDARD_EXTENSIONS)

    def roots(self) -> list[str]:
        """Quick scans are limited to four roots; else the scan paths, or the document root."""
        if self.scan_profile == "quick":
            return [self.document_root + p for p in QUICK_ROOTS]
        return list(self.scan_paths) or [self.document_root]

    def entropy_enabled(self) -> bool:
        """Off flag first, then on flag, then the deep profile's option, then the strict profiles."""
        if self.entropy_off:
            return False
        return self.entropy or (self.scan_profile == "deep" and self.entropy_deep) or self.profile in ("strict", "paranoid")

    def confined(self) -> None:
        root = normal_path(self.document_root)
        for p in self.roots():
            n = normal_path(p)
            if root and n != root and not n.startswith(root + "/") or "/../" in p + "/":
                raise ConfigError("scan_path_outside_document_root")

    def to_dict(self) -> dict:
        return asdict(self)
