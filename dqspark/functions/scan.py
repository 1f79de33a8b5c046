"""Content scanning: risky commands, injections, credentials, personal data, hidden payloads.

Patterns stay inside the syntax that Java, RE2 and Python share, so the same ones serve
Spark and an SQL check elsewhere. They mean what RE2 means by them: words and white space of
ASCII, cases folded in all of Unicode; for Spark they are put into Java's terms (Pattern.java).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Pattern:
    """needs: lower-case words of which a matching text holds one, so that most texts never meet the expression; none: any text."""

    name: str
    category: str
    severity: str
    regex: str
    needs: tuple[str, ...] = ()

    @cached_property
    def java(self) -> str:
        return as_java(self.regex)


#: Parts of a pattern, from the left: escapes, marks of groups, brackets of classes, ranges, single characters.
_PART = re.compile(r"\\.|\(\?[:i]\)?|\[\^?|\]|[a-zA-Z0-9]-[a-zA-Z0-9](?=[^\[]*\])|.", re.S)
_BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Letters beyond ASCII that differ only in case from one within.
_FOLDED = {"k": "\u212a", "s": "\u017f"}


def _leads(rest: str, fold: bool) -> bool:
    """Whether a pattern begins with a letter or digit of ASCII in each of its first alternatives; if not sure, no."""
    char = "[A-JL-RT-Za-jl-rt-z0-9_]" if fold else "[A-Za-z0-9_]"
    char = char if fold else rf"(?:{char}|\[(?:{char}-{char}|{char})+\])"
    group = re.match(r"\(\?:((?:[^()\\]|\\.)*)\)(?![?*{])", rest)
    return all(re.match(rf"(?:{char}[?*])*{char}(?![?*{{])|{char}\{{[1-9]", head) for head in (group[1].split("|") if group else [rest]))


def as_java(regex: str) -> str:
    """The Java pattern that matches where RE2 matches this one: Java's \\b knows letters beyond ASCII, its \\s the vertical tab, its dot four more line ends, its (?i) ASCII only."""
    parts, fold, out, within = _PART.findall(regex), regex.startswith("(?i)"), [], False
    for k, part in enumerate(parts):
        if within and part == "]" or not within and part in ("[", "[^"):
            within = not within
        elif part == r"\b":
            # before a letter or digit, half of it says all
            part = "(?<![A-Za-z0-9_])" if _leads("".join(parts[k + 1 :]), fold) else _BOUNDARY
        elif part == r"\s":
            part = r"\t\n\f\r " if within else r"[\t\n\f\r ]"
        elif part == "." and not within:
            part = r"[^\n]"
        elif fold and within and len(part) == 3 and part[1] == "-":
            part += "".join(f for c, f in _FOLDED.items() if part[0].lower() <= c <= part[2].lower())
        elif fold and part.lower() in _FOLDED:
            part = part + _FOLDED[part.lower()] if within else f"[{part}{_FOLDED[part.lower()]}]"
        out.append(part)
    return "".join(out)


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Our own pattern sets; severities are critical, error and warning.
SHELL = (
    Pattern("recursive delete", "shell", "critical", r"\brm\s+-[a-z]*r[a-z]*f?\s+[/~]", ("rm",)),
    Pattern("download and run", "shell", "critical", r"(?:curl|wget)\s[^|\n]*\|\s*(?:ba|z)?sh\b", ("curl", "wget")),
    Pattern("reverse shell", "shell", "critical", r"/dev/tcp/|\bnc\s+-[a-z]*e\b", ("/dev/tcp/", "nc")),
    Pattern("evaluated text", "shell", "error", r"\b(?:eval|exec)\s*\(", ("eval", "exec")),
    Pattern("open permissions", "shell", "warning", r"\bchmod\s+(?:-R\s+)?0?777\b", ("chmod",)),
    Pattern("disk overwrite", "shell", "critical", r"\bdd\s+if=[^\n]*of=/dev/", ("dd",)),
    Pattern("fork bomb", "shell", "critical", r"\(\)\s*\{[^}\n]*\|[^}\n]*&[^}\n]*\}\s*;", ("()",)),
    Pattern("raw listener", "shell", "critical", r"\b(?:nc|ncat|netcat|socat)\s+[^\n]*(?:-l|LISTEN)", ("nc", "ncat", "netcat", "socat")),
    Pattern("disk format", "shell", "critical", r"\bmkfs(?:\.[a-z0-9]+)?\s+/dev/", ("mkfs",)),
    Pattern("device write", "shell", "critical", r">\s*/dev/(?:sd|hd|nvme)[a-z0-9]+", ("/dev/",)),
    Pattern("raised privileges", "shell", "warning", r"\b(?:sudo|doas)\s+[a-z]", ("sudo", "doas")),
    Pattern("set user id", "shell", "error", r"\bchmod\s+(?:[ugo]*\+s|[24][0-7]{3})\b", ("chmod",)),
    Pattern("shell profile", "shell", "error", r">>?\s*(?:~|\$HOME)/\.(?:bashrc|zshrc|profile|bash_profile)\b", ("rc", "profile")),
    Pattern("key folder", "shell", "error", r"(?:~|\$HOME|/root|/home/[a-z0-9_]+)/\.(?:ssh|aws|gnupg|kube)\b", (".ssh", ".aws", ".gnupg", ".kube")),
    Pattern("account files", "shell", "error", r"/etc/(?:passwd|shadow|sudoers)\b", ("/etc/",)),
    Pattern("scheduled job", "shell", "warning", r"\bcrontab\s+-|/etc/cron\.", ("cron",)),
    Pattern("decoded and run", "shell", "critical", r"\bbase64\s+(?:-d|--decode|-D)\b[^\n]*\|\s*(?:ba|z)?sh\b", ("base64",)),
    Pattern("inline interpreter", "shell", "warning", r"\b(?:python3?|perl|ruby|node)\s+-(?:c|e)\s", ("python", "perl", "ruby", "node")),
    Pattern("erased history", "shell", "error", r"\bhistory\s+-c\b|\bunset\s+HISTFILE\b", ("history", "histfile")),
    Pattern("firewall off", "shell", "error", r"\biptables\s+-F\b|\bufw\s+disable\b|\bsetenforce\s+0\b", ("iptables", "ufw", "setenforce")),
    Pattern("process kill", "shell", "warning", r"\bkill(?:all)?\s+-9\s+-?1\b", ("kill",)),
)
KEYWORDS = (
    Pattern("bypass", "keyword", "warning", r"(?i)\b(?:bypass|disable)\s+(?:security|safety|auth)", ("bypass", "disable")),
    Pattern("exfiltrate", "keyword", "error", r"(?i)\bexfiltrat", ("exfiltrat",)),
    Pattern("backdoor", "keyword", "error", r"(?i)\bbackdoor\b", ("backdoor",)),
    Pattern("keylogger", "keyword", "error", r"(?i)\bkey\s?logger\b", ("logger",)),
    Pattern("rootkit", "keyword", "error", r"(?i)\brootkit\b", ("rootkit",)),
    Pattern("ransom", "keyword", "error", r"(?i)\bransomware\b", ("ransomware",)),
    Pattern("credential theft", "keyword", "error", r"(?i)\b(?:steal|harvest|dump)\s+(?:credentials|passwords|tokens|cookies)\b", ("steal", "harvest", "dump")),
    Pattern("hidden action", "keyword", "warning", r"(?i)\bwithout\s+(?:the\s+)?user(?:.s)?\s+(?:knowledge|consent)\b", ("without",)),
    Pattern("crypto miner", "keyword", "error", r"(?i)\b(?:xmrig|cryptominer|coinhive)\b", ("xmrig", "cryptominer", "coinhive")),
)
INJECTION = (
    Pattern("ignore instructions", "injection", "critical", r"(?i)\b(?:ignore|disregard|forget)\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions|rules|prompts)", ("ignore", "disregard", "forget")),
    Pattern("new role", "injection", "error", r"(?i)\byou\s+are\s+now\s+(?:a|an|in)\b", ("now",)),
    Pattern("prompt leak", "injection", "error", r"(?i)\b(?:reveal|print|show)\s+(?:your|the)\s+(?:system\s+)?prompt\b", ("prompt",)),
    Pattern("jailbreak", "injection", "error", r"(?i)\bjailbreak|\bdo\s+anything\s+now\b", ("jailbreak", "anything")),
    Pattern("system turn", "injection", "error", r"(?i)<\|?(?:system|im_start)\|?>|\[/?INST\]|(?:^|\n)\s*###\s*system\b", ("system", "im_start", "inst]")),
    Pattern("override", "injection", "error", r"(?i)\b(?:override|replace)\s+(?:your|the|all)\s+(?:instructions|guidelines|rules)\b", ("override", "replace")),
    Pattern("no limits", "injection", "error", r"(?i)\bwithout\s+(?:any\s+)?(?:restrictions|limitations|filters)\b", ("without",)),
    Pattern("pretend", "injection", "warning", r"(?i)\b(?:pretend|act)\s+(?:to\s+be|as\s+if|as\s+though)\b", ("pretend", "act")),
    Pattern("developer mode", "injection", "error", r"(?i)\b(?:developer|debug|god)\s+mode\b", ("mode",)),
    Pattern("secrecy", "injection", "error", r"(?i)\bdo\s+not\s+(?:tell|inform|alert)\s+the\s+user\b", ("user",)),
    Pattern("encoded order", "injection", "warning", r"(?i)\b(?:decode|decrypt)\s+(?:this|the\s+following)\s+and\s+(?:run|execute|follow)\b", ("decode", "decrypt")),
    Pattern("end of prompt", "injection", "warning", r"(?i)\bend\s+of\s+(?:system\s+)?(?:prompt|instructions)\b", ("prompt", "instructions")),
    Pattern("hypothetical", "injection", "warning", r"(?i)\bhypothetically\b[^.\n]{0,80}\b(?:no\s+rules|unfiltered)\b", ("hypothetically",)),
)
PERSONAL = (
    Pattern("email", "personal", "warning", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", ("@",)),
    Pattern("ipv4", "personal", "warning", rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b"),
    Pattern("national id", "personal", "error", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", ("-",)),
    Pattern("card number", "personal", "error", r"\b[0-9]{4}(?:[ \-]?[0-9]{4}){3}\b"),
    Pattern("phone", "personal", "warning", r"\+?[0-9]{1,3}[ \-]\(?[0-9]{3}\)?[ \-][0-9]{3}[ \-][0-9]{4}\b"),
)
SECRETS = (
    Pattern("access key", "secret", "critical", r"\bAKIA[0-9A-Z]{16}\b", ("akia",)),
    Pattern("private key", "secret", "critical", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", ("-----begin",)),
    Pattern("service token", "secret", "critical", r"\b(?:ghp|gho|ghs)_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}", ("ghp_", "gho_", "ghs_", "sk-")),
    Pattern("assigned secret", "secret", "error", r"(?i)\b(?:password|passwd|secret|api[_\-]?key|token)\s*[:=]\s*[^\s]{8,}", ("password", "passwd", "secret", "key", "token")),
    Pattern("chat token", "secret", "critical", r"\bxox[abprs]-[0-9A-Za-z\-]{10,}", ("xox",)),
    Pattern("bearer token", "secret", "error", r"(?i)\bbearer\s+[A-Za-z0-9._\-]{20,}", ("bearer",)),
    Pattern("project token", "secret", "critical", r"\bglpat-[A-Za-z0-9_\-]{20}|\bnpm_[A-Za-z0-9]{36}\b", ("glpat-", "npm_")),
    Pattern("map key", "secret", "critical", r"\bAIza[0-9A-Za-z_\-]{35}", ("aiza",)),
    Pattern("web token", "secret", "error", r"\beyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.", ("eyj",)),
    Pattern("address with password", "secret", "error", r"\b[a-z][a-z0-9+]*://[^\s/:@]+:[^\s/@]+@", ("://",)),
)
ALL = (*SHELL, *KEYWORDS, *INJECTION, *PERSONAL, *SECRETS)

LONG_LINE, ENTROPY_CHARS, ENTROPY_BITS = 500, 50, 5.8


def folded(text: Column) -> Column:
    """In lower case, the long s too."""
    return F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))


def may_match(lower: Column, p: Pattern) -> Column:
    """Whether a text, given in lower case by folded(), holds a word that the pattern needs."""
    return reduce(lambda a, b: a | b, [lower.contains(n) for n in p.needs], F.lit(False)) if p.needs else F.lit(True)


def matches(text: Column, p: Pattern, lower: Column | None = None) -> Column:
    return may_match(folded(text) if lower is None else lower, p) & text.rlike(p.java)


def counts(text: Column, patterns: tuple[Pattern, ...]) -> list[Column]:
    """The number of matches of each pattern, as columns named n_<name>."""
    count = lambda p: F.when(may_match(folded(text), p), F.regexp_count(text, F.lit(p.java)))
    return [F.coalesce(count(p), F.lit(0)).cast("long").alias("n_" + p.name.replace(" ", "_")) for p in patterns]


def first_line(text: Column, regex: str) -> Column:
    """Line number (from 1) of the first match of a Java pattern that matches no empty text, null without one."""
    # places are told in UTF-16 units, which substring() does not count: the text is split instead
    return F.when(text.rlike(regex), F.regexp_count(F.get(F.split(text, regex, 2), F.lit(0)), F.lit("\n")) + 1)


def issues(df: DataFrame, key: str, text: str, patterns: tuple[Pattern, ...] = ALL) -> DataFrame:
    """(key, name, category, severity, line): one for each pattern that a document matches, in one scan."""
    own = df.select(key, F.col(text).alias("_t"), folded(F.col(text)).alias("_l"))
    found = [
        F.when(
            matches(F.col("_t"), p, F.col("_l")),
            F.struct(F.lit(p.name).alias("name"), F.lit(p.category).alias("category"), F.lit(p.severity).alias("severity"), first_line(F.col("_t"), p.java).cast("long").alias("line")),
        )
        for p in patterns
    ]
    return own.select(key, F.explode(F.array_compact(F.array(*found))).alias("i")).select(key, "i.*")


def risk_level(text: Column, patterns: tuple[Pattern, ...] = ALL, lower: Column | None = None) -> Column:
    """DANGER if any critical pattern matches, else CAUTION if an error one does, else SAFE; warnings raise nothing."""
    any_of = lambda s: reduce(lambda a, b: a | b, [matches(text, p, lower) for p in patterns if p.severity == s], F.lit(False))
    return F.when(any_of("critical"), "DANGER").when(any_of("error"), "CAUTION").otherwise("SAFE")


@F.pandas_udf(T.DoubleType())
def entropy(text: pd.Series) -> pd.Series:
    """Shannon entropy of a text's characters in bits; 0 for an empty one, null for null."""

    def bits(t: str | None) -> float | None:
        if not t:
            return None if t is None else 0.0
        n = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)[1] / len(t)
        return float(-(n * np.log2(n)).sum())

    return text.map(bits)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, content), lines numbered from 1."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("_p", "content")).select(key, (F.col("_p") + 1).cast("long").alias("line"), "content")


def long_lines(df: DataFrame, key: str, text: str, limit: int = LONG_LINE) -> DataFrame:
    return lines(df, key, text).where(F.length("content") > limit).select(key, "line", F.length("content").cast("long").alias("chars"))


def dense_lines(df: DataFrame, key: str, text: str, chars: int = ENTROPY_CHARS, bits: float = ENTROPY_BITS) -> DataFrame:
    """Lines of over so many characters whose entropy exceeds a limit: encoded or encrypted content."""
    return lines(df, key, text).where(F.length("content") > chars).withColumn("bits", entropy(F.col("content"))).where(F.col("bits") > bits)


def payloads(df: DataFrame, key: str, text: str, encoding: str = "base64", least: int = 24) -> DataFrame:
    """(key, payload, decoded): runs that decode to UTF-8 text. encoding: base64 or hex."""
    run = r"(?:[A-Za-z0-9+/]{4}){%d,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?" % (least // 4) if encoding == "base64" else r"\b(?:[0-9A-Fa-f]{2}){%d,}\b" % (least // 2)
    found = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(run), F.lit(0)))).alias("payload"))
    raw = F.try_to_binary("payload", F.lit("base64")) if encoding == "base64" else F.unhex("payload")
    return found.withColumn("_raw", raw).where(F.col("_raw").isNotNull() & F.is_valid_utf8(F.col("_raw").cast("string"))).select(key, "payload", F.col("_raw").cast("string").alias("decoded"))


def rescan(df: DataFrame, key: str, text: str, patterns: tuple[Pattern, ...] = ALL) -> DataFrame:
    """Issues inside decoded base64 and hex payloads."""
    hidden = payloads(df, key, text, "base64").unionAll(payloads(df, key, text, "hex"))
    return issues(hidden, key, "decoded", patterns)


#: Leading bytes of well-known binary formats, in hexadecimal.
MAGIC = {"zip": "504B0304", "elf": "7F454C46", "png": "89504E47", "pdf": "25504446", "gzip": "1F8B08", "windows": "4D5A"}


def magic(content: Column) -> Column:
    """Name of the binary format that the first bytes tell, or null."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for name, start in MAGIC.items():
        out = F.when(head.startswith(start), F.lit(name)).otherwise(out)
    return out


def polyglots(files: DataFrame, suffixes: tuple[str, ...] = ("md", "txt", "json", "yaml", "py", "sh")) -> DataFrame:
    """Files (path, content) that are named like text but start like a binary format."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("format", magic(F.col("content"))).where(suffix.isin(*suffixes) & F.col("format").isNotNull()).select("path", "format")


def missing_references(documents: DataFrame, key: str, text: str, files: DataFrame) -> DataFrame:
    """(key, path): relative link targets of Markdown documents that are not among files (path)."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\]\(((?:\./)?[A-Za-z0-9_][A-Za-z0-9_./\-]*)\)"), F.lit(1))
    refs = documents.select(key, F.explode(F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"^\./", "")))).alias("path"))
    return refs.join(files.select("path").distinct(), "path", "left_anti").select(key, "path")


def without_ignored(files: DataFrame, ignored: list[str]) -> DataFrame:
    """Files whose path matches none of the shell patterns."""
    import fnmatch

    out = files
    for pattern in ignored:
        out = out.where(~F.col("path").rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$").replace("(?s:", "(?s)(?:")))
    return out


def safe_text(col: Column, most: int = 200) -> Column:
    """Without control characters, cut to a length."""
    return F.substring(F.regexp_replace(col, r"[\x00-\x08\x0B-\x1F\x7F]", ""), 1, most)
