"""Settings, repository names and the allow list."""

from __future__ import annotations

import os
import posixpath
import re
from dataclasses import dataclass, field, replace

from revloom.errors import Forbidden, InvalidInput

_SEGMENT = re.compile(r"^[A-Za-z0-9._-]+$")
# Spellings of yes and no.
_YES, _NO = {"1", "true", "yes", "on"}, {"0", "false", "no", "off", ""}


@dataclass(frozen=True)
class RepoConfig:
    owner: str
    name: str
    default_branch: str = "main"
    max_prs: int = 200
    since: str | None = None
    min_support: int = 2
    allow_single_high_confidence: bool = False
    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=list)


def repo_slug(text: str) -> tuple[str, str]:
    """(owner, name) of a slug; both must be plain names."""
    parts = text.strip().split("/")
    if len(parts) != 2 or any(not _SEGMENT.match(p) or p in (".", "..") for p in parts):
        raise InvalidInput(f"not an owner/name slug: {text!r}")
    return parts[0], parts[1]


def scoped_path(root: str, slug: str, *segments: str) -> str:
    """A path below the folder of one repository; anything that would leave it is refused."""
    owner, name = repo_slug(slug)
    base = posixpath.join(root, "repos", owner, name) if "://" in root else os.path.abspath(os.path.join(root, "repos", owner, name))
    if any("\x00" in s or os.path.isabs(s) or ".." in s.split("/") for s in segments):
        raise InvalidInput("unsafe path")
    path = posixpath.join(base, *segments)
    if path != base and not path.startswith(base + "/"):
        raise InvalidInput("unsafe path")
    return path


def config_of(owner: str, name: str, said: dict) -> RepoConfig:
    """Settings from the object of a config file; what it leaves out, or has of another kind, keeps its default."""
    part = lambda k: said[k] if isinstance(said.get(k), dict) else {}
    backfill, compiling, paths = part("backfill"), part("compile"), part("paths")
    values = {
        "default_branch": said.get("defaultBranch"), "max_prs": backfill.get("maxPrs"), "since": backfill.get("since"), "min_support": compiling.get("minSupport"),
        "allow_single_high_confidence": compiling.get("allowSingleHighConfidence"), "include": paths.get("include"), "exclude": paths.get("exclude"),
    }
    default = RepoConfig(owner, name)
    fits = {k: v for k, v in values.items() if v is not None and (isinstance(v, str) if k == "since" else type(v) is type(getattr(default, k)))}
    for k in ("max_prs", "min_support"):
        if fits.get(k, 1) < 1:
            raise InvalidInput(f"{k} must be a positive whole number")
    return replace(default, **fits)


def allow_list(text: str | None) -> set[str] | None:
    found = {x.strip() for x in (text or "").split(",") if x.strip()}
    for slug in found:
        repo_slug(slug)
    return found or None


def check_allowed(slug: str, allowed: set[str] | None) -> None:
    if allowed and slug not in allowed:
        raise Forbidden(f"{slug} is not on the allow list")


def as_bool(text: str | None, default: bool = False) -> bool:
    if text is None:
        return default
    low = text.strip().lower()
    if low in _YES:
        return True
    if low in _NO:
        return False
    raise InvalidInput(f"not a yes or no: {text!r}")


def as_positive(name: str, text: str | None, default: int) -> int:
    if text is None or not text.strip():
        return default
    if not re.fullmatch(r"\d+", text.strip()) or int(text) < 1:
        raise InvalidInput(f"{name} must be a positive whole number")
    return int(text)


def resolve(config: RepoConfig, env: dict[str, str] | None = None) -> RepoConfig:
    """``config`` with what the environment sets; the environment wins."""
    env = os.environ if env is None else env
    return replace(config, min_support=as_positive("REVLOOM_MIN_SUPPORT", env.get("REVLOOM_MIN_SUPPORT"), config.min_support))
