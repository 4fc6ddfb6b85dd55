"""Expressions on names, paths and texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that some systems reserve for devices.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))
#: Where local paths that are censored begin, and characters that end them.
CENSORED_ROOTS = ("home", "tmp", "var", "usr", "Users")
CENSORED_ENDS = r"\s<>\"':"
#: The same for paths that are redacted; those of a drive end otherwise.
REDACTED_ROOTS = ("home", "root", "Users", "tmp", "var", "opt")
REDACTED_ENDS, REDACTED_DRIVE_ENDS = r"\s<>|", r":*?\"<>|\r\n"
#: Secrets in texts and what they become, in this order.
SECRETS = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"(?i)Bearer\s+[a-z0-9_\-.]{16,}", "Bearer [REDACTED_TOKEN]"),
    (r"(?i)(?:api[_-]?key|secret|token|password)[\"']?\s*[:=]\s*[\"']?[a-z0-9_\-.]{16,}[\"']?", "secret=[REDACTED_SECRET]"),
)


def base_name(path: Column) -> Column:
    """What follows the last slash of either kind, trailing ones aside."""
    return F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"([^/\\]*)$", 1)


def safe_name(name: Column) -> Column:
    """True for a bare name: not blank, no separators or unsafe characters, no device name before its last dot."""
    stem = F.upper(F.regexp_replace(name, r"(?s)\.[^.]*$", ""))
    return (F.trim(name) != "") & ~name.rlike(r"[/\\<>:\"|?*\x00]") & ~stem.isin(*RESERVED)


def path_code(path: Column, size: Column | None = None, most: int | None = None) -> Column:
    """``ABSOLUTE_PATH``, ``PATH_TRAVERSAL``, ``UNSAFE_FILENAME``, ``FILE_TOO_LARGE`` or ``OK``, the first that holds."""
    clean = F.trim(path)
    absolute = clean.startswith("/") | (F.substring(clean, 2, 1) == ":") | clean.startswith("\\\\")
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    climbs = slashed.rlike(r"(^|/)\.\.(/|$)") | F.contains(slashed, F.lit("../")) | slashed.startswith("..")
    last = F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]*)$", 1)
    out = F.when(absolute, "ABSOLUTE_PATH").when(climbs, "PATH_TRAVERSAL").when(~safe_name(last), "UNSAFE_FILENAME")
    if size is not None and most is not None:
        out = out.when(size > most, "FILE_TOO_LARGE")
    return out.otherwise("OK")


def upload_name(raw: Column) -> Column:
    """A clean name for an upload: its base name; where that isn't plain, the stem's odd characters become ``_`` (64 at
    most) and the suffix keeps letters and digits (10 at most). Nothing left: ``upload.bin``."""
    name = F.trim(base_name(F.coalesce(raw, F.lit(""))))
    suffix = F.regexp_extract(name, r"(?s)[^.](\.[^.]+)$", 1)
    stem = F.when(suffix == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(suffix)))
    stem = F.substring(F.regexp_replace(stem, r"[^a-zA-Z0-9_\-]", "_"), 1, 64)
    cleaned = F.concat(F.when(stem == "", "file").otherwise(stem), F.substring(F.regexp_replace(F.lower(suffix), r"[^a-zA-Z0-9_.]", ""), 1, 10))
    plain = safe_name(name) & name.rlike(r"^[a-zA-Z0-9_\-.]+$")
    return F.when((name == "") | name.isin(".", ".."), "upload.bin").when(plain, name).otherwise(cleaned)


def censor_paths(text: Column) -> Column:
    """Absolute local paths, of a drive or below ``CENSORED_ROOTS``, become their last component; one that ends in a
    separator becomes ``local_file``."""
    out = F.coalesce(text, F.lit(""))
    roots = "|".join(CENSORED_ROOTS)
    for begin, separator in ((r"[a-z]:\\", r"\\"), (rf"/(?:{roots})/", "/")):
        inside, name = rf"[^{CENSORED_ENDS}]", rf"[^{CENSORED_ENDS}{separator}]"
        out = F.regexp_replace(out, rf"(?i){begin}(?:{inside}*{separator})?({name}+)(?!{inside})", "$1")
        out = F.regexp_replace(out, rf"(?i){begin}{inside}*{separator}(?!{inside})", "local_file")
    return out


def redact(text: Column) -> Column:
    """``SECRETS`` are masked, in their order; then absolute paths, of a drive or below ``REDACTED_ROOTS``, become
    ``[artifact: parent/name]`` of their last two components, the drive or root being one, or ``[artifact: name]`` of the
    only one."""
    out = F.coalesce(text, F.lit(""))
    for pattern, mask in SECRETS:
        out = F.regexp_replace(out, pattern, mask)
    roots = "|".join(REDACTED_ROOTS)
    kinds = (("", "[a-zA-Z]:", r"[\\/]", r"\\/", REDACTED_DRIVE_ENDS), ("/", f"(?:{roots})", "/", "/", REDACTED_ENDS))
    for before, top, separator, separators, ends in kinds:
        inside, name = rf"[^{ends}]", rf"[^{ends}{separators}]"
        two = rf"{before}(?:{top}{separator}(?:{inside}*{separator})?({name}+)|({top})){separator}+({name}+){separator}*(?!{inside})"
        out = F.regexp_replace(out, two, "[artifact: $1$2/$3]")
        out = F.regexp_replace(out, rf"{before}({top}){separator}{{2,}}(?!{inside})", "[artifact: $1]")
    return out


def escape_like(term: Column) -> Column:
    """The term with backslash, ``%`` and ``_`` escaped, for LIKE with ``ESCAPE '\\'``."""
    return F.regexp_replace(term, r"([\\%_])", r"\\$1")


def content_type(content: Column) -> Column:
    """By the first bytes: png, jpeg, gif, webp or bmp; else ``application/octet-stream``."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("424D"), "image/bmp")
        .otherwise("application/octet-stream")
    )


def framework(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.when(suffix == ".onnx", "onnx").when(suffix.isin(".pt", ".pth"), "pytorch").when(suffix == ".ts", "torchscript").otherwise("unknown")


def access_level(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.when(suffix.isin(".onnx", ".ts", ".torchscript"), "white_box").otherwise("metadata_only")


def geometry(width: Column, height: Column, size: Column) -> tuple[Column, Column]:
    """Aspect ratio and bytes per pixel; a missing or zero dimension counts as 256."""
    w = F.coalesce(F.nullif(width, F.lit(0)), F.lit(256))
    h = F.coalesce(F.nullif(height, F.lit(0)), F.lit(256))
    return w / F.greatest(F.lit(1), h), size / F.greatest(F.lit(1), w * h)


def deterministic_id(sha256: Column, assessment: Column, kind: Column, namespace: str) -> Column:
    """The version 5 UUID of ``sha:assessment:kind`` in a namespace given as 32 hexadecimal digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(F.concat_ws(":", sha256, assessment, kind), "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
