"""What code and strings tell about a function: calls by category, kinds of strings, activity profile, risk and flags.

All are columns over one row: sets of names are constants in the plan, so nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinworks.functions.catalog import CATEGORIES, DANGEROUS
from skeinworks.functions.names import api_name

#: A call in code, and the words before a bracket that are none.
CALL = r"\b([A-Za-z_@][A-Za-z0-9_@!:.]*)\s*\("
KEYWORDS = ("if", "for", "while", "switch", "case", "return", "sizeof", "do", "catch", "try", "else", "new", "delete")

#: Patterns of strings, in the order in which they are tried.
STRING_KINDS = (
    ("ip", r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"),
    ("url", r"^(?i:https?)://[\w.-]+(?:/[\w./?%&=-]*)?$"),
    ("registry", r"^(HKEY_|HK[A-Z]{2})[\\A-Za-z0-9_-]+$"),
    ("path", r"^/[a-zA-Z0-9/_.-]+$"),
    ("path", r'^[A-Za-z]:\\[^<>:"|?*]+$'),
    ("domain", r"^[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}$"),
)
NO_DOMAIN = r"\.(dll|exe|sys|lib|obj|pdb|h|c|cpp)$|^version\.rc$"
SYSTEM_PATH = r"^(/etc|/root|/var)|(?i:\\windows|\\system32|\\programdata)"

#: By trait, the names of calls in lower case: whole names, parts of names, beginnings of names.
TRAITS = {
    "server": (("listen", "accept", "wsaaccept", "acceptsecuritycontext"), ("_accept",), ()),
    "connects": (("connect", "winhttpconnect", "internetconnect", "ssl_connect"), ("internetconnecta", "internetconnectw"), ("wsaconnect",)),
    "sends": (("winhttpwritedata", "internetwritefile", "ssl_write"), ("send",), ()),
    "receives": (("winhttpreaddata", "internetreadfile", "ssl_read"), ("recv",), ()),
    "http": ((), ("httpopen", "httpsend", "winhttp", "internet", "curl_"), ()),
    "resolves": ((), ("getaddrinfo", "gethostbyname", "gethostbyaddr", "getnameinfo", "gethostname"), ()),
    "reads": (("read", "pread", "fread", "fgets", "fgetc", "getc", "fscanf", "mapviewoffile"), ("readfile",), ()),
    "writes": (("write", "pwrite", "fwrite", "fputs", "fputc", "putc", "fprintf"), ("writefile", "copyfile", "movefile"), ()),
    "deletes": (("remove", "unlink"), ("delete", "removedirectory"), ()),
    "encrypts": ((), ("encrypt",), ()),
    "decrypts": ((), ("decrypt",), ()),
    "hashes": ((), ("hash", "md5", "sha1", "sha256", "digest"), ()),
    "injects": ((), ("writeprocessmemory", "createremotethread", "virtualalloc"), ()),
}


def called_names(code: Column) -> Column:
    """The distinct names before a bracket in a piece of code, without keywords, sorted."""
    found = F.array_distinct(F.regexp_extract_all(code, F.lit(CALL), F.lit(1)))
    return F.coalesce(F.array_sort(F.filter(found, lambda n: ~F.lower(n).isin(*KEYWORDS))), F.array().cast("array<string>"))


def in_category(names: Column, wanted: frozenset[str]) -> Column:
    """The normal forms of the names that are in a set themselves or in normal form, sorted."""
    hit = F.filter(names, lambda n: n.isin(*sorted(wanted)) | api_name(n).isin(*sorted(wanted)))
    return F.array_sort(F.array_distinct(F.transform(hit, api_name)))


def known_calls(names: Column) -> Column:
    """The names that any set of the catalogue has, themselves or in normal form: the few that need be looked at again."""
    every = sorted({n for wanted in [*CATEGORIES.values(), *DANGEROUS.values()] for n in wanted})
    return F.filter(names, lambda n: n.isin(*every) | api_name(n).isin(*every))


def api_columns(names: Column) -> dict[str, Column]:
    """network, file, crypto, process: calls by category; risks: kinds of dangerous calls, sorted."""
    out = {kind: in_category(names, wanted) for kind, wanted in CATEGORIES.items()}
    risks = F.array_compact(F.array(*[F.when(F.size(in_category(names, wanted)) > 0, risk) for risk, wanted in sorted(DANGEROUS.items())]))
    return out | {"risks": risks}


def string_kind(value: Column) -> Column:
    """ip, url, registry, path or domain, by the first pattern that fits; null for anything else.

    A string of less than 3 signs is nothing, nor is an address with a part over 255 or a file that looks like a domain.
    """
    text = F.trim(value)
    low = F.lower(text)
    octets = F.forall(F.split(text, r"\."), lambda x: F.try_to_number(F.substring(x, 1, 9), F.lit("999999999")) <= 255)
    out = None
    for kind, pattern in STRING_KINDS:
        found = F.lit(kind)
        if kind == "ip":
            found = F.when(octets, "ip")
        elif kind == "domain":
            found = F.when(~(low.rlike(NO_DOMAIN) | (low.contains("microsoft.com") & low.contains("schema"))), "domain")
        out = F.when(text.rlike(pattern), found) if out is None else out.when(text.rlike(pattern), found)
    return F.when(F.length(value) >= 3, out)


def kinds_of(words: Column) -> Column:
    """(word, kind) of the words that are of any kind; most words have no sign that a pattern needs and are not tried."""
    may_be = F.filter(words, lambda w: w.contains(".") | w.contains("/") | w.contains("\\") | F.trim(w).startswith("HK"))
    return F.filter(F.transform(may_be, lambda w: F.struct(w.alias("word"), string_kind(w).alias("kind"))), lambda x: x["kind"].isNotNull())


def has_system_path(paths: Column) -> Column:
    return F.exists(paths, lambda p: p.rlike(SYSTEM_PATH))


def _trait(names: Column, trait: str) -> Column:
    whole, parts, starts = TRAITS[trait]

    def fits(name: Column) -> Column:
        low = F.lower(name)
        test = low.isin(*whole) if whole else F.lit(False)
        for part in parts:
            test = test | low.contains(part)
        for start in starts:
            test = test | low.startswith(start)
        return test

    return F.exists(names, fits)


def _has(c: Column) -> Column:
    return F.size(c) > 0


def profile(network: Column, file: Column, crypto: Column, process: Column) -> Column:
    """The labels of what the calls do, joined by `, `; NONE without any."""
    client = _trait(network, "connects") | _trait(network, "http")
    server = _trait(network, "server")
    io = (_trait(network, "sends") | _trait(network, "receives")) & ~server & ~client
    reads, writes = _trait(file, "reads"), _trait(file, "writes")
    encrypts, decrypts = _trait(crypto, "encrypts"), _trait(crypto, "decrypts")
    labels = [
        F.when(server, "NETWORK_SERVER"),
        F.when(client, "NETWORK_CLIENT"),
        F.when(io, "NETWORK_IO"),
        F.when(_trait(network, "resolves"), "DNS_RESOLVER"),
        F.when(reads & writes, "FILE_RW").when(writes, "FILE_WRITER").when(reads, "FILE_READER"),
        F.when(_trait(file, "deletes"), "FILE_DELETER"),
        F.when(_has(crypto), F.when(encrypts & decrypts, "CRYPTO_CIPHER").when(encrypts, "CRYPTO_ENCRYPT").when(decrypts, "CRYPTO_DECRYPT").when(_trait(crypto, "hashes"), "CRYPTO_HASH").otherwise("CRYPTO_USER")),
        F.when(_has(process), F.when(_trait(process, "injects"), "PROCESS_INJECTOR").otherwise("PROCESS_SPAWNER")),
        F.when(_has(network) & _has(file), "MIXED_IO"),
    ]
    joined = F.array_join(F.array_compact(F.array(*labels)), ", ")
    return F.when(joined == "", "NONE").otherwise(joined)


def risk_score(f: dict[str, Column]) -> Column:
    """The sum of weights of network, file, crypto, process, risks (calls) and ips, urls, domains, paths, registry (strings)."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    critical = F.array_contains(f["risks"], "BUFFER_OVERFLOW_RISK") | F.array_contains(f["risks"], "COMMAND_INJECTION_RISK")
    return (
        points(_has(f["network"]), 2)
        + points(_has(f["ips"]), 3)
        + points(_has(f["urls"]), 2)
        + points(_has(f["domains"]), 1)
        + points(_has(f["file"]), 1)
        + points(has_system_path(f["paths"]), 3)
        + points(_has(f["crypto"]), 1)
        + points(_has(f["process"]), 2)
        + points(_has(f["registry"]), 2)
        + points(_has(f["risks"]), 3)
        + points(critical, 2)
        + points(_has(f["network"]) & _has(f["file"]), 2)
        + points(_has(f["network"]) & _has(f["crypto"]), 2)
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= 6, "HIGH").when(score >= 3, "MEDIUM").otherwise("LOW")


def security_flags(f: dict[str, Column], activity: Column, level: Column) -> Column:
    """The flags of a function, in their fixed order."""
    network, file, crypto, process, risks = (_has(f[k]) for k in ("network", "file", "crypto", "process", "risks"))
    says = lambda *labels: activity.rlike("|".join(labels))
    first = [
        F.when(network, "NETWORK_CAPABLE"),
        F.when(network & says("NETWORK_SERVER"), "ACCEPTS_CONNECTIONS"),
        F.when(network & says("NETWORK_CLIENT"), "INITIATES_CONNECTIONS"),
        F.when(network & says("DNS_RESOLVER"), "PERFORMS_DNS_LOOKUP"),
        F.when(file, "FILE_IO_CAPABLE"),
        F.when(file & says("FILE_WRITER", "FILE_RW"), "WRITES_FILES"),
        F.when(file & says("FILE_READER", "FILE_RW"), "READS_FILES"),
        F.when(file & says("FILE_DELETER"), "DELETES_FILES"),
        F.when(crypto, "USES_CRYPTO"),
        F.when(crypto & says("CRYPTO_ENCRYPT"), "ENCRYPTS_DATA"),
        F.when(crypto & says("CRYPTO_DECRYPT"), "DECRYPTS_DATA"),
        F.when(process, "SPAWNS_PROCESSES"),
        F.when(process & says("PROCESS_INJECTOR"), "PROCESS_INJECTION_CAPABLE"),
        F.when(risks, "CALLS_DANGEROUS_FUNCTIONS"),
    ]
    last = [
        F.when(_has(f["ips"]), "CONTAINS_HARDCODED_IPS"),
        F.when(_has(f["urls"]), "CONTAINS_URLS"),
        F.when(_has(f["domains"]), "CONTAINS_DOMAINS"),
        F.when(_has(f["registry"]), "ACCESSES_REGISTRY"),
        F.when(has_system_path(f["paths"]), "ACCESSES_SYSTEM_PATHS"),
        F.when(network & file, "POTENTIAL_DATA_EXFILTRATION"),
        F.when(network & crypto, "ENCRYPTED_NETWORK_COMMS"),
        F.when(network & risks, "NETWORK_WITH_VULN_RISK"),
        F.when(level == "HIGH", "HIGH_RISK").when(level == "MEDIUM", "MEDIUM_RISK"),
    ]
    return F.concat(F.array_compact(F.array(*first)), f["risks"], F.array_compact(F.array(*last)))


#: What is counted in code as a branch, a loop and a call.
BRANCHES = (r"\bif\s*\(", r"\bswitch\s*\(", r"\bcase\s+", r"\?.*:")
LOOPS = (r"\bwhile\s*\(", r"\bfor\s*\(", r"\bdo\s*\{")
CALLS = r"\b[a-zA-Z_][a-zA-Z0-9_]*\s*\("


def complexity(code: Column) -> dict[str, Column]:
    """n_lines, n_branches, n_loops, n_calls and level of a piece of code; an empty one has none of them."""
    count = lambda p: F.coalesce(F.regexp_count(code, F.lit(p)), F.lit(0))
    branches, loops = sum(map(count, BRANCHES), F.lit(0)), sum(map(count, LOOPS), F.lit(0))
    calls = F.greatest(F.lit(0), count(CALLS) - branches - loops)
    lines = F.when(F.length(code) > 0, F.size(F.split(F.regexp_replace(code, "\n+$", ""), "\n"))).otherwise(0)
    step = lambda c, low, high: F.when(c > high, 2).when(c > low, 1).otherwise(0)
    score = step(lines, 20, 50) + step(branches, 5, 10) + step(calls, 4, 8) + step(loops, 1, 3)
    level = F.when(score >= 6, "very_complex").when(score >= 4, "complex").when(score >= 2, "moderate").otherwise("simple")
    return {"n_lines": lines, "n_branches": branches, "n_loops": loops, "n_calls": calls, "level": level}
