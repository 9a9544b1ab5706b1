"""Small stores beside a scan: reports, baselines, whitelist rules, suppressions, feeds, quarantine.

They hold configuration and results of one site, written with restricted modes; the data of a scan stays in Spark."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import time
import uuid

from palisade.operators.whitelist import checked

DIR_MODE, FILE_MODE = 0o700, 0o600
# Places whose restoring needs a confirmation.
CRITICAL_RESTORE = [r"(^|/)\.htaccess$", r"(^|/)\.user\.ini$", r"(^|/)php\.ini$", r"/bitrix/\.settings\.php$", r"/bitrix/php_interface/(dbconn|init)\.php$", r"/local/php_interface/(dbconn|init)\.php$", r"/bitrix/(admin|modules|tools)/", r"/local/modules/"]
FEED_LIMIT = 26_214_400


class StoreError(RuntimeError):
    pass


def runtime_directory(document_root: str, name: str, base: str | None = None) -> str:
    """A private folder outside the document root."""
    base = base or os.path.join(os.path.dirname(document_root.rstrip("/")) or "/tmp", ".palisade")
    if os.path.realpath(base).startswith(os.path.realpath(document_root).rstrip("/") + "/"):
        raise StoreError("runtime_directory_inside_document_root")
    path = os.path.join(base, name)
    os.makedirs(path, DIR_MODE, exist_ok=True)
    os.chmod(path, DIR_MODE)
    return path


def write_json(path: str, value) -> None:
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(draft, "w") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
    os.chmod(draft, FILE_MODE)
    os.replace(draft, path)


def read_json(path: str, default=None):
    try:
        with open(path) as f:
            return json.load(f)
    except (OSError, ValueError):
        return default


class Reports:
    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, DIR_MODE, exist_ok=True)

    def path(self, scan_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", scan_id):
            raise StoreError("report_id_invalid")
        return os.path.join(self.folder, f"{scan_id}.json")

    def save(self, scan_id: str, summary: dict, config: dict, results: list[dict]) -> str:
        write_json(self.path(scan_id), {"format": "palisade-report", "format_version": 1, "created_at": time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime()), "summary": summary, "config": config, "results": results})
        return self.path(scan_id)

    def load(self, scan_id: str) -> dict:
        got = read_json(self.path(scan_id))
        if not isinstance(got, dict):
            raise StoreError("report_not_found")
        for r in got.get("results", []):
            r.setdefault("tags", [])
            r.setdefault("normalized_hash", None)
        got["summary"].setdefault("informational_total", 0)
        return got

    def list(self, limit: int = 50) -> list[dict]:
        names = [n for n in os.listdir(self.folder) if n.endswith(".json")]
        names.sort(key=lambda n: (-os.stat(os.path.join(self.folder, n)).st_mtime, n))
        found = ((n[:-5], read_json(os.path.join(self.folder, n))) for n in names)
        return [{"scan_id": i, **r["summary"]} for i, r in found if isinstance(r, dict) and "summary" in r][:limit]

    def delete(self, scan_id: str) -> None:
        if os.path.exists(self.path(scan_id)):
            os.remove(self.path(scan_id))


class Rules:
    """Whitelist rules; adding an active equal one again changes nothing."""

    def __init__(self, path: str):
        self.path = path

    def all(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        got = read_json(self.path)
        if not isinstance(got, dict) or not isinstance(got.get("rules"), list):
            raise StoreError("whitelist_rules_corrupted")
        return got["rules"]

    def add(self, **rule) -> dict:
        checked(rule)
        parts = [rule["type"], *(str(rule.get(k, "")) for k in ("path", "pattern", "hash", "signature_id"))]
        mark = hashlib.sha256("\n".join(parts).encode()).hexdigest()
        rules = self.all()
        for r in rules:
            if r["fingerprint"] == mark and r["active"]:
                return r
        made = {"id": uuid.uuid4().hex[:12], "active": True, "fingerprint": mark} | rule
        write_json(self.path, {"rules": [*rules, made]})
        return made

    def set_active(self, rule_id: str, active: bool) -> None:
        write_json(self.path, {"rules": [r | {"active": active} if r["id"] == rule_id else r for r in self.all()]})

    def delete(self, rule_id: str) -> None:
        write_json(self.path, {"rules": [r for r in self.all() if r["id"] != rule_id]})


class Suppressions:
    """Fingerprints set aside; a broken file suppresses nothing."""

    def __init__(self, path: str):
        self.path = path

    def all(self) -> list[dict]:
        got = read_json(self.path, {})
        return got.get("items", []) if isinstance(got, dict) and isinstance(got.get("items"), list) else []

    def add(self, fingerprint: str, **item) -> None:
        items = self.all()
        if all(i.get("fingerprint") != fingerprint for i in items):
            write_json(self.path, {"items": [*items, {"fingerprint": fingerprint, "scope": "finding", **item}]})

    def delete(self, fingerprint: str) -> None:
        write_json(self.path, {"items": [i for i in self.all() if i.get("fingerprint") != fingerprint]})

    def frame(self, spark):
        return spark.createDataFrame([(i["fingerprint"],) for i in self.all()], "fingerprint string")


def read_feed(path: str) -> list[dict]:
    """Feed rows of a JSON file (a list, or under items or hashes, or one object) or of a text file of hashes."""
    if os.path.getsize(path) > FEED_LIMIT:
        raise StoreError("feed_too_large")
    with open(path, errors="replace") as f:
        text = f.read()
    try:
        got = json.loads(text)
    except ValueError:
        kept = (line.split("#", 1)[0].strip() for line in text.splitlines())
        return [{"ord": i, "hash": x.split()[0]} for i, x in enumerate(kept) if x]
    if isinstance(got, dict):
        got = got.get("items") or got.get("hashes") or [got]
    rows = [x if isinstance(x, dict) else {"hash": x} for x in got]
    return [{"ord": i, **r, "hash": r.get("hash") or r.get("sha256")} for i, r in enumerate(rows)]


def read_list(path: str, key: str, what: str) -> tuple[dict, list, list[str]]:
    """(the object, its list under ``key``, warnings) of a JSON database. A file that is not there is an empty one, without a warning."""
    if not path.strip() or not os.path.isfile(path):
        return {}, [], []
    if not os.access(path, os.R_OK):
        return {}, [], [f"{what}_not_readable:{path}"]
    try:
        with open(path, errors="replace") as f:
            text = f.read()
    except OSError:
        text = ""
    if not text.strip():
        return {}, [], [f"{what}_empty_or_unreadable:{path}"]
    try:
        got = json.loads(text)
    except ValueError:
        got = None
    if not isinstance(got, dict) or not isinstance(got.get(key), (list, dict)):
        return {}, [], [f"{what}_invalid_json:{path}"]
    algorithm = str(got.get("algorithm") or "sha256").lower()
    if algorithm != "sha256":
        return {}, [], [f"{what}_unsupported_algorithm:{algorithm}"]
    items = got[key]
    return got, list(items.values()) if isinstance(items, dict) else items, []


def read_hashes(path: str) -> tuple[list[dict], list[str]]:
    """(items, warnings) of a hash database; an item's source is by default that of the file."""
    got, items, warnings = read_list(path, "items", "malware_hashes")
    source = got.get("source") if isinstance(got.get("source"), dict) else {}
    default = source.get("name", "malware_hashes")
    rows = [{"ord": i, **x, "source": x.get("source", default), "tags": x.get("tags") if isinstance(x.get("tags"), list) else []} for i, x in enumerate(items) if isinstance(x, dict)]
    return rows, warnings


def read_prefixes(path: str) -> tuple[int, list[str], list[str]]:
    """(length, prefixes, warnings) of a prefix index; its length is held within 8 to 12."""
    got, items, warnings = read_list(path, "prefixes", "malware_hash_prefixes")
    try:
        length = int(got.get("prefix_length", 8))
    except (TypeError, ValueError):
        length = 0
    return min(12, max(8, length)), [str(x) for x in items], warnings


def read_domains(path: str) -> list[dict]:
    """Items of a domain list; whatever fails gives an empty one. A repeated domain keeps its first place and takes the last values."""
    from palisade.operators.urls import plain_domain

    try:
        with open(path, errors="replace") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return []
    items = got.get("items") if isinstance(got, dict) else None
    found: dict[str, dict] = {}
    for x in items if isinstance(items, list) else []:
        domain = plain_domain(str(x.get("domain") or "")) if isinstance(x, dict) else ""
        if domain:
            severity = str(x.get("severity", "high")).strip().lower()
            found[domain] = {"domain": domain, "severity": severity if severity in ("info", "low", "medium", "high", "critical") else "high", "tags": x.get("tags") if isinstance(x.get("tags"), list) else []}
    return [{"ord": i, **x} for i, x in enumerate(found.values())]


class Snapshots:
    """Named baselines in versions: each is written to a folder of its own that does not change again, and the pointer of a name moves to it when
    it is whole. A write that fails leaves the pointer, and so the baseline, as it was."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, DIR_MODE, exist_ok=True)

    def _named(self, name: str, *parts: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", name) or name.strip(".") == "":
            raise StoreError("baseline_name_invalid")
        return os.path.join(self.folder, name, *parts)

    def write(self, df, name: str = "default") -> str:
        """Write a version and point to it; gives its id. Rows are in order of their path within sorted files."""
        version = f"{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
        place = self._named(name, version)
        os.makedirs(self._named(name), DIR_MODE, exist_ok=True)
        df.repartitionByRange("relative_path").sortWithinPartitions("relative_path").write.parquet(place)
        write_json(self._named(name, f"{version}.json"), {"version": version, "created_at": time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime()), "files": df.sparkSession.read.parquet(place).count()})
        write_json(self._named(name, "latest.json"), {"version": version})
        return version

    def latest(self, name: str = "default") -> str:
        got = read_json(self._named(name, "latest.json"))
        if not isinstance(got, dict):
            raise StoreError("baseline_not_found")
        return got["version"]

    def read(self, spark, name: str = "default", version: str | None = None):
        version = version or self.latest(name)
        if not os.path.exists(self._named(name, f"{version}.json")):
            raise StoreError("baseline_version_not_found")
        return spark.read.parquet(self._named(name, version))

    def list(self, name: str = "default", limit: int = 20) -> list[dict]:
        """The newest versions first."""
        if not os.path.isdir(self._named(name)):
            return []
        names = sorted((n for n in os.listdir(self._named(name)) if n.endswith(".json") and n != "latest.json"), reverse=True)
        return [m for n in names[:limit] if isinstance(m := read_json(self._named(name, n)), dict)]

    def names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if os.path.exists(os.path.join(self.folder, n, "latest.json")))

    def difference(self, spark, name: str, old: str, new: str | None = None):
        """What changed from one version to another, the latest by default."""
        from palisade.operators import baseline

        return baseline.difference(self.read(spark, name, old), self.read(spark, name, new))


REPORT_SORTS = ("scan_id", "started_at", "status", "finished_at", "processed_files", "found_total", "runtime_errors", "profile")
REPORT_NUMBERS = ("processed_files", "found_total", "runtime_errors")


def sorted_reports(reports: list[dict], field: str = "started_at", order: str = "desc") -> list[dict]:
    """A list of report summaries by one field; unknown ones by start. Equal ones stay as they are."""
    field = field if field in REPORT_SORTS else "started_at"
    key = (lambda r: int(r.get(field) or 0)) if field in REPORT_NUMBERS else (lambda r: str(r.get(field) or ""))
    return stable(reports, key, order)


def stable(rows: list[dict], key, order: str) -> list[dict]:
    down = order.lower() != "asc"
    return [r for _, r in sorted(enumerate(rows), key=lambda x: (key(x[1]), -x[0] if down else x[0]), reverse=down)]


#: Actions on chosen rows of a report: the rule type they add, and the row's columns that the rule takes.
WHITELIST_ACTIONS = {
    "whitelist_file_signature": ("file_signature", ("file_path", "signature_id")), "whitelist_signature": ("signature", ("signature_id",)), "whitelist_hash": ("hash", ("file_hash",)), "whitelist_path": ("path", ("file_path",)),
}
RULE_FIELDS = {"file_path": "path", "file_hash": "hash", "signature_id": "signature_id"}


def bulk_action(rows, action: str, rules: Rules | None = None, marks: Suppressions | None = None, quarantine: Quarantine | None = None, ids: list[str] | None = None, created_by: int = 0) -> dict[str, int]:
    """Carry out an action on rows of a report's projection, all of them or those of ``ids``; gives how many were done and failed.

    What rows have in common is done once: Spark makes the chosen columns distinct, and one value at a time comes to the driver, which
    owns the small stores. Database rows have no file to move."""
    from pyspark.sql import functions as F

    chosen = rows if ids is None else rows.where(F.col("id").isin([str(i) for i in ids]))
    if action in WHITELIST_ACTIONS:
        kind, columns = WHITELIST_ACTIONS[action]
        todo = lambda r: rules.add(type=kind, created_by=created_by, **{RULE_FIELDS[c]: r[c] for c in columns})
    elif action == "suppress_finding":
        columns, todo = ("finding_fingerprint",), lambda r: marks.add(r["finding_fingerprint"], created_by=created_by)
    elif action == "quarantine_file":
        chosen = chosen.where(~F.col("file_path").startswith("bitrix-db://"))
        columns, todo = ("file_path",), lambda r: quarantine.take(r["file_path"], "report")
    else:
        raise StoreError(f"report_action_unknown:{action}")
    done = {"done": 0, "failed": 0}
    for r in chosen.select(*columns).distinct().orderBy(*columns).toLocalIterator():
        try:
            todo(r)
            done["done"] += 1
        except (OSError, ValueError, RuntimeError):  # a rule that is refused, a file that is gone
            done["failed"] += 1
    return done


RULE_SORTS = ("id", "active", "type", "value", "created_at", "created_by", "disabled_at")


def exception_rows(rules: list[dict], suppressions: list[dict], field: str = "created_at", order: str = "desc") -> list[dict]:
    """Whitelist rules and suppressed findings as one list: id, active, type, value, created_at, created_by, disabled_at."""
    value = lambda r: next((str(r[k]) for k in ("path", "pattern", "hash", "signature_id") if r.get(k)), "")
    rows = [{"id": str(r.get("id", "")), "active": bool(r.get("active")), "type": r.get("type", ""), "value": value(r), **{k: r.get(k) for k in ("created_at", "created_by", "disabled_at")}} for r in rules]
    rows += [{"id": f"suppression:{s.get('fingerprint', '')}", "active": True, "type": "finding", "value": str(s.get("fingerprint", "")), **{k: s.get(k) for k in ("created_at", "created_by")}, "disabled_at": None} for s in suppressions]
    field = field if field in RULE_SORTS else "created_at"
    key = (lambda r: int(r.get(field) or 0)) if field in ("active", "created_by") else (lambda r: str(r.get(field) or ""))
    return stable(rows, key, order)


def allowed_feed_url(url: str, hosts: tuple[str, ...] = ()) -> bool:
    """Only https on the listed hosts, or a local file; nothing is fetched here."""
    m = re.fullmatch(r"https://([^/:@]+)(/[^?#]*)", url)
    return url.startswith("file:///") or bool(m and m[1].lower() in hosts)


class Quarantine:
    """Moves files aside with a verified copy, and back."""

    def __init__(self, folder: str, document_root: str):
        self.folder, self.root = folder, document_root.rstrip("/")
        os.makedirs(folder, DIR_MODE, exist_ok=True)

    def _meta(self, item: str) -> str:
        return os.path.join(self.folder, item, "meta.json")

    @staticmethod
    def digest(path: str) -> str:
        h = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
        return h.hexdigest()

    def take(self, path: str, reason: str = "", delete: bool = False) -> dict:
        if not os.path.realpath(path).startswith(os.path.realpath(self.root) + "/"):
            raise StoreError("quarantine_outside_document_root")
        item = f"{time.strftime('%Y%m%d_%H%M%S', time.gmtime())}_{uuid.uuid4().hex[:8]}"
        place = os.path.join(self.folder, item)
        os.makedirs(place, DIR_MODE)
        before = self.digest(path)
        payload = os.path.join(place, "payload.bin")
        shutil.copyfile(path, payload)
        os.chmod(payload, FILE_MODE)
        if self.digest(payload) != before:
            raise StoreError("quarantine_checksum_mismatch")
        os.remove(path)
        meta = {"id": item, "original_path": path, "sha256": before, "status": "quarantined", "reason": reason, "events": ["quarantined"]}
        if delete:
            os.remove(payload)
            meta |= {"status": "deleted", "events": ["quarantined", "deleted"]}
        write_json(self._meta(item), meta)
        return meta

    def items(self) -> list[dict]:
        found = [m for n in sorted(os.listdir(self.folder), reverse=True) if isinstance(m := read_json(self._meta(n)), dict)]
        return [m | {"payload_exists": os.path.exists(os.path.join(self.folder, m["id"], "payload.bin"))} for m in found]

    def is_critical(self, path: str) -> bool:
        p = path.replace("\\", "/")
        return p.lower() == f"{self.root}/index.php".lower() or any(re.search(x, p, re.I) for x in CRITICAL_RESTORE)

    def restore(self, item: str, confirm_critical: bool = False) -> dict:
        meta = read_json(self._meta(item))
        if not isinstance(meta, dict) or meta["status"] != "quarantined":
            raise StoreError("quarantine_item_not_restorable")
        payload, target = os.path.join(self.folder, item, "payload.bin"), meta["original_path"]
        if self.digest(payload) != meta["sha256"]:
            raise StoreError("quarantine_checksum_mismatch")
        if os.path.exists(target):
            raise StoreError("quarantine_target_exists")
        if self.is_critical(target) and not confirm_critical:
            raise StoreError("quarantine_critical_confirmation_required")
        shutil.move(payload, target)
        meta |= {"status": "restored", "events": [*meta["events"], "restored"]}
        write_json(self._meta(item), meta)
        return meta

    def delete_payload(self, item: str) -> dict:
        meta = read_json(self._meta(item))
        payload = os.path.join(self.folder, item, "payload.bin")
        if os.path.exists(payload):
            os.remove(payload)
        meta |= {"status": "deleted", "events": [*meta["events"], "deleted"]}
        write_json(self._meta(item), meta)
        return meta
