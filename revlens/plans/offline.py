"""A deterministic stand-in for the model service, for the registered queries and
tests (no network)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from revlens import rules
from revlens.operators.score import ModelError

_FILE_BLOCK = re.compile(r"### File: ([^\n]*) \(language: ([^)\n]*)\)\n```diff\n(.*?)\n```\n", re.S)
_CHUNK_NO = re.compile(r"\(chunk (\d+)/(\d+)\)")
_SYSTEM_TO_AGENT = {p: a for a, p in rules.REVIEWER_PROMPTS.items()}


def offline_findings(agent: str, files: list[tuple[str, str, str]]) -> list[dict]:
    """What the offline model reports for a chunk, by reviewer and file."""
    out = []
    for path, language, patch in files:
        n_lines = len(patch.split("\n"))
        if agent == "security" and patch != "":
            out.append({"severity": "WARNING", "category": "hardcoded_secret", "file": path, "line": n_lines,
                        "message": "Credential-like value on the last added line", "suggestion": "Load it at runtime"})
        elif agent == "performance" and language in ("python", "go", "sql", "tsx"):
            out.append({"severity": "info" if n_lines < 30 else "warning", "category": "algorithm", "file": path,
                        "line": 1, "message": f"Review loop cost over {n_lines} lines", "suggestion": "Batch the work"})
        elif agent == "style" and n_lines % 2 == 0:
            out.append({"severity": "info", "category": "naming", "file": path, "line": 2,
                        "message": "Inconsistent naming", "suggestion": "Follow the project convention"})
        elif agent == "test" and language == "dockerfile":
            out.append({"severity": "warning", "category": "missing_test", "file": path, "line": 0,
                        "message": "Container build is untested", "suggestion": "Add a build check"})
    return out


class OfflineScorer:
    """Deterministic scorer: parses the prompt like a model would read it.

    Failure injection by chunk index (0-based): `% 11 == 10` a non-retryable
    ValidationException; `% 13 == 12` throttled on every attempt; `% 5 == 3`
    throttled on the first attempt only. Replies of the security reviewer for
    `% 7 == 6` come fenced inside prose; performance replies for `% 9 == 8`
    are not JSON.
    """

    def __init__(self, inject_failures: bool = True):
        self.inject = inject_failures
        self.last: str | None = None  # the call before, if it was refused

    def __call__(self, prompt: str, system_prompt: str, model_id: str, request_key: str = "", **params) -> dict:
        m = _CHUNK_NO.search(prompt)
        chunk_index = int(m.group(1)) - 1 if m else 0
        agent = _SYSTEM_TO_AGENT.get(system_prompt, "security")
        # retries of a call follow it at once, so one remembered key is enough
        again, self.last = self.last == (agent, request_key, prompt), (agent, request_key, prompt)
        if self.inject:
            if chunk_index % 11 == 10:
                raise ModelError("ValidationException", "input rejected")
            if chunk_index % 13 == 12:
                raise ModelError("ThrottlingException", "rate exceeded")
            if chunk_index % 5 == 3 and not again:
                raise ModelError("ThrottlingException", "rate exceeded")
        files = _FILE_BLOCK.findall(prompt)
        body = json.dumps({"findings": offline_findings(agent, files)})
        if agent == "security" and chunk_index % 7 == 6:
            text = "Findings below.\n```json\n" + body + "\n```\nEnd of review."
        elif agent == "performance" and chunk_index % 9 == 8:
            text = "No structured answer available."
        else:
            text = body
        return {"text": text, "tokens_in": (len(prompt) + 3) // 4, "tokens_out": len(text) // 4, "latency_ms": 0}


def offline_scorer_factory() -> Callable[[str, str, str], dict]:
    return OfflineScorer()


def no_sleep(_seconds: float) -> None:
    """Injected sleep for tests and the offline scorer (waits are recorded)."""
