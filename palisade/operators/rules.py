"""Signature rules as data, and the expressions that evaluate them."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.hashes import collapsed
from palisade.functions.paths import extension, lowered
from palisade.schema import finding, let, some

# The built-in catalogue (id, category, severity, score, pattern, flags, prefilter mode and strings, extensions, path suffix).
PHPX = "php phtml phtm php3 php4 php5 php6 php7 inc".split()
JSX = "js html htm php phtml tpl".split()
HTMLX = "html htm php phtml tpl js".split()
BXX = "php phtml phtm inc".split()


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    score: int
    pattern: str | None
    strings: tuple[str, ...] = ()
    mode: str = "any"
    extensions: tuple[str, ...] = ()
    path_contains: str = ""
    path_equals: str = ""
    flags: str = "i"


def _r(id, category, severity, score, pattern, strings="", extensions=(), mode="any", **more):
    return Rule(id, category, severity, score, pattern, tuple(strings.split()), mode, tuple(extensions), **more)


RULES = (
    _r("php_eval", "php_code_execution", "high", 5, r"\beval\s*\(", "eval", PHPX),
    _r("php_assert", "php_code_execution", "high", 4, r"\bassert\s*\(", "assert", PHPX),
    _r("php_create_function", "php_code_execution", "high", 4, r"\bcreate_function\s*\(", "create_function", PHPX),
    _r("php_shell_exec", "php_code_execution", "high", 5, r"\b(shell_exec|exec|system|passthru|proc_open|popen|pcntl_exec)\s*\(", "shell_exec exec system passthru proc_open popen pcntl_exec", PHPX),
    _r("php_base64_decode", "php_obfuscation", "medium", 2, r"\bbase64_decode\s*\(", "base64_decode", PHPX),
    _r("php_obfuscation_helpers", "php_obfuscation", "medium", 2, r"\b(gzinflate|gzuncompress|str_rot13)\s*\(", "gzinflate gzuncompress str_rot13", PHPX),
    _r("php_hex_pack", "php_obfuscation", "medium", 3, r"""\bpack\s*\(\s*["']H\*["']""", "pack H*", PHPX, "all"),
    _r("php_request_callable", "webshell_behavior", "high", 6, r"\$_(GET|POST|REQUEST|COOKIE)\s*\[[^\]]+\]\s*\(", "$_GET $_POST $_REQUEST $_COOKIE", PHPX),
    _r("php_dangerous_include_from_request", "filesystem_abuse", "high", 6, r"\b(include|require|include_once|require_once)\s*\(?\s*\$_(GET|POST|REQUEST|COOKIE)", "include require include_once require_once", PHPX),
    _r("php_input_write", "webshell_behavior", "high", 6, r"""file_put_contents\s*\(\s*["']php:\/\/input["']\s*,""", "file_put_contents php://input", PHPX, "all"),
    _r("php_wrapper_filter", "filesystem_abuse", "high", 5, r"php:\/\/filter", "php://filter", [*PHPX, "txt"]),
    _r("php_preg_replace_eval", "php_code_execution", "high", 5, r"""preg_replace\s*\(\s*['"].*\/e['"]\s*,""", "preg_replace", PHPX),
    _r("php_long_base64", "php_obfuscation", "medium", 3, r"[A-Za-z0-9+\/]{160,}={0,2}", "", [*PHPX, "js", "html", "htm", "txt"], flags=""),
    _r("js_from_char_code", "javascript_injection", "medium", 3, r"fromCharCode\s*\(", "fromCharCode", JSX),
    _r("js_legacy_unescape", "javascript_injection", "medium", 3, r"\bunescape\s*\(", "unescape", JSX),
    _r("js_atob_payload", "javascript_injection", "low", 2, r"\batob\s*\(", "atob", JSX),
    _r("js_timer_code", "javascript_injection", "low", 2, r"\b(setTimeout|setInterval)\s*\(", "setTimeout setInterval", JSX),
    _r("html_iframe", "javascript_injection", "low", 2, r"<\s*iframe\b", "iframe", HTMLX),
    _r("html_object_embed", "javascript_injection", "low", 2, r"<\s*(object|embed)\b", "object embed", HTMLX),
    _r("html_phishing_form", "phishing_markup", "medium", 4, r"""<\s*form\b[^>]*action\s*=\s*["'][^"']*(login|signin|bank|account|paypal|wallet|metamask|binance)[^"']*["']""", "form action", "html htm php phtml tpl".split(), "all"),
    _r("bitrix_php_in_upload", "bitrix_specific", "high", 8, None, "", "php phtml phtm php3 php4 php5 php6 php7".split(), path_contains="/upload/"),
    _r("bitrix_authorize_hardcoded_id", "bitrix_specific", "high", 8, r"\$USER\s*->\s*Authorize\s*\(\s*\d+\s*\)", "Authorize", BXX),
    _r("bitrix_init_dynamic_execution", "bitrix_specific", "high", 7, r"\b(eval|assert|shell_exec|exec|system|passthru)\s*\(", "eval assert shell_exec exec system passthru", ["php"], path_equals="/bitrix/php_interface/init.php"),
    _r("bitrix_include_from_upload", "bitrix_specific", "high", 7, r"""\b(include|require|include_once|require_once)\s*\(?\s*[^;]*(\/upload\/|["']upload\/)""", "upload", BXX),
    _r("bitrix_suspicious_access_php", "bitrix_specific", "medium", 4, r"\b(eval|base64_decode|shell_exec|assert|file_put_contents)\s*\(", "eval base64_decode shell_exec assert file_put_contents", ["php"], path_equals="/.access.php"),
    _r("bitrix_event_handler_dynamic_exec", "bitrix_specific", "high", 6, r"(AddEventHandler|registerEventHandler)[^;]*(eval|assert|shell_exec|exec|system|base64_decode)", "AddEventHandler registerEventHandler eval assert shell_exec exec system base64_decode", BXX, flags="is"),
    _r("bitrix_upload_to_executable", "bitrix_specific", "high", 6, r"""move_uploaded_file\s*\([^;]+\.(php|phtml|php3|php4|php5|php7)['"]""", "move_uploaded_file", BXX),
)

_WORD = f"[{string.ascii_letters}{string.digits}_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def java_pattern(pattern: str, flags: str = "i") -> str:
    """A byte-wise PCRE pattern for the JVM: word boundaries and digits by ASCII alone. Ranges of letters and digits in a class are spelt out:
    the JVM looks single characters up in a table, and tries ranges one after the other."""
    out, i, opened = "", 0, -1  # opened: where the class that is being read has its first member
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair[0] == "\\" and len(pair) == 2:
            out += {"\\b": _BOUNDARY, "\\/": "/"}.get(pair, pair)
            i += 2
            continue
        if opened < 0 and pair[0] == "[":
            opened = i + (2 if pair == "[^" else 1)
            out, i = out + pattern[i:opened], opened
            continue
        if opened >= 0 and pair[0] == "]" and i > opened:
            opened = -1
        elif opened >= 0 and pair[1:] == "-" and pattern[i + 2 : i + 3] not in ("", "]", "\\"):
            out += spelt(pair[0], pattern[i + 2])
            i += 3
            continue
        out += pair[0]
        i += 1
    return (f"(?{flags})" if flags else "") + out


def spelt(first: str, last: str) -> str:
    """A class's range: all of its members if both ends are letters of one case, or digits."""
    for known in (string.ascii_lowercase, string.ascii_uppercase, string.digits):
        if first in known and last in known and first <= last:
            return known[known.index(first) : known.index(last) + 1]
    return f"{first}-{last}"


def external_rules(text: str) -> list[Rule]:
    """Rules of a signature file: one delimited pattern a line, '#' comments; ids count kept lines."""
    out, n = [], 0
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        line = line.split(" #", 1)[0].strip()
        n += 1
        m = re.fullmatch(r"([^\w\s\\])(.*)\1([a-zA-Z]*)", line, re.S)
        if m is None or set(m[3]) - set("imsxu"):
            continue
        try:
            re.compile(m[2])
        except re.error:
            continue
        out.append(Rule(f"external_signature_{n}", "external", "medium", 3, m[2], flags="".join(sorted(set(m[3]) - {"u"}))))
    return out


def path_facts(path: Column) -> Column:
    """What rules ask of a path: its lower-case form and its extension."""
    return F.struct(lowered(path).alias("lower"), extension(path).alias("ext"))


def known_places(rules=RULES) -> list[tuple[str, str]]:
    """What rules with a pattern ask of a path besides its extension: a text in it, and its end."""
    return sorted({(r.path_contains.lower(), r.path_equals.lower()) for r in rules if r.pattern is not None} - {("", "")})


def at_known_place(path: Column, rules=RULES) -> Column:
    """Whether some rule's pattern is sought at the path for its place; all other paths of one extension meet the same patterns."""
    p = lowered(path)
    out = F.lit(False)
    for part, end in known_places(rules):
        out = out | (p.contains(part) & F.endswith(p, F.lit(end)))
    return out


def named_by_number(suffix: str, rules=RULES) -> bool:
    """Whether a file whose name is a number and this suffix may be at a known place."""
    return any(part or re.fullmatch(f"(?:.*/)?[0-9]*{re.escape(suffix)}", end) or suffix.endswith(end) for part, end in known_places(rules))


def path_matches(rule: Rule, facts: Column) -> Column:
    p = facts["lower"]
    out = F.lit(True)
    if rule.path_contains:
        out = out & p.contains(rule.path_contains.lower())
    if rule.path_equals:
        out = out & F.endswith(p, F.lit(rule.path_equals.lower()))
    if rule.extensions:
        out = out & facts["ext"].isin(*rule.extensions)
    return out


def passes_prefilter(rule: Rule, lower_content: Column) -> Column:
    """Cheap literal test before the pattern; rules without strings pass."""
    tests = [lower_content.contains(s.lower()) for s in rule.strings]
    out = F.lit(True)
    if tests:
        out = tests[0]
        for t in tests[1:]:
            out = out & t if rule.mode == "all" else out | t
    return out


def excerpt_at(content: Column, offset: Column) -> Column:
    return collapsed(F.substr(content, F.greatest(offset - 60, F.lit(0)) + 1, F.lit(160)))


def rule_finding(rule: Rule, path: Column, content: Column, lower_content: Column, prefilter: bool = True, facts: Column | None = None) -> Column:
    """The finding of one rule, or null: the first match alone counts. ``facts`` are the path's, where they are known."""
    facts = path_facts(path) if facts is None else facts
    base = {"category": rule.category, "severity": rule.severity, "score": rule.score}
    if rule.pattern is None:
        return F.when(path_matches(rule, facts), finding(rule.id, target="path", rule_type="path", excerpt="", **base))
    p = java_pattern(rule.pattern, rule.flags)
    cheap = path_matches(rule, facts) & (passes_prefilter(rule, lower_content) if prefilter else F.lit(True))
    at = (F.regexp_instr(content, F.lit(p)) - 1).cast("long")
    hit = F.when(cheap, content.rlike(p)).otherwise(False)
    return F.when(hit, finding(rule.id, offset=at, excerpt=excerpt_at(content, at.cast("int")), **base))


def rule_findings(path: Column, content: Column, rules=RULES, prefilter: bool = True, paths: bool = True) -> Column:
    """Path rules first, then content rules, each in catalogue order. What all rules read of a file is computed once."""
    ordered = [r for r in rules if r.pattern is None and paths] + [r for r in rules if r.pattern is not None]
    read = F.struct(F.lower(content).alias("content"), path_facts(path).alias("path"))
    return let(read, lambda x: some(*[rule_finding(r, path, content, x["content"], prefilter, x["path"]) for r in ordered]))
