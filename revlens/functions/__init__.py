"""Column expressions (all JVM-side, codegen-friendly; no Python UDFs)."""

from revlens.functions.crypto import hmac_sha256_hex, signature_matches
from revlens.functions.paths import detect_language, file_extension, is_generated_file, map_file_status
from revlens.functions.render import finding_markdown, review_comment_parts, title_case
from revlens.functions.secrets import secret_rule_index, secret_rule_name, secret_rule_severity
from revlens.functions.text import (
    category_label,
    code_fence_extract,
    finding_location,
    py_strip,
    severity_normalise,
    severity_rank,
)

__all__ = [
    "category_label",
    "code_fence_extract",
    "detect_language",
    "file_extension",
    "finding_location",
    "finding_markdown",
    "hmac_sha256_hex",
    "is_generated_file",
    "map_file_status",
    "py_strip",
    "review_comment_parts",
    "secret_rule_index",
    "secret_rule_name",
    "secret_rule_severity",
    "severity_normalise",
    "severity_rank",
    "signature_matches",
    "title_case",
]
