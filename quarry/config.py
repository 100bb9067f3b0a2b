"""Settings of an audit: defaults, then a TOML file, then what the command line gives."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields
from typing import Any

from quarry.operators.extract import FURNITURE
from quarry.sources.crawl import Options

AGENT = "quarry/1.0 (+mailto:you@example.com)"
ENGINES = ("auto", "dictionary", "off")


class ConfigError(ValueError):
    """Settings that can't be used."""


@dataclass(frozen=True)
class Config:
    start_url: str = ""
    # scope
    max_urls: int = 10_000
    max_depth: int = 0
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    use_sitemap: bool = True
    follow_links: bool = True
    # politeness; a host is always asked by one task, so there is no number of workers
    delay: float = 0.7
    timeout: float = 20.0
    user_agent: str = AGENT
    respect_robots: bool = True
    max_retries: int = 3
    forbidden_limit: int = 10
    max_redirect_hops: int = 10
    # checks
    spellcheck: bool = True
    spellcheck_engine: str = "auto"
    dictionary: str = ""  # a text file of words, one a line
    lang: str = "en"
    spellcheck_whitelist: tuple[str, ...] = ()
    brand_term_min_pages: int = 3
    furniture_headings: tuple[str, ...] = ()
    destination_anchors: tuple[str, ...] = ()
    image_head_limit: int = 5
    image_sample_per_template: int = 25
    oversized_image_bytes: int = 300 * 1024
    near_duplicate_distance: int = 8
    # PageSpeed
    psi: bool = False
    psi_api_key: str = ""
    psi_top: int = 10
    psi_delay: float = 1.5
    psi_strategy: str = "mobile"
    # places
    cache_dir: str = ""
    recrawl: bool = False
    output_dir: str = "."
    html_report: bool = False
    diff_against: str = ""
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        for p in (*self.include, *self.exclude):
            try:
                re.compile(p)
            except re.error as e:
                raise ConfigError(f"not a regular expression: {p} ({e})") from e
        if self.spellcheck_engine not in ENGINES:
            raise ConfigError(f"spellcheck_engine is one of {', '.join(ENGINES)}")
        if self.psi_strategy not in ("mobile", "desktop"):
            raise ConfigError("psi_strategy is mobile or desktop")

    def crawl_options(self) -> Options:
        return Options(
            max_urls=self.max_urls, max_depth=self.max_depth, include=self.include, exclude=self.exclude, use_sitemap=self.use_sitemap, follow_links=self.follow_links, delay=self.delay, timeout=self.timeout,
            user_agent=self.user_agent, respect_robots=self.respect_robots, max_retries=self.max_retries, forbidden_limit=self.forbidden_limit, max_hops=self.max_redirect_hops,
        )

    def furniture(self) -> list[str]:
        return [*FURNITURE, *(h.lower() for h in self.furniture_headings)]

    def spelling(self) -> tuple[bool, str]:
        """Whether spelling is checked, and a warning where it should be but can't."""
        if not self.spellcheck or self.spellcheck_engine == "off":
            return False, ""
        return (True, "") if self.dictionary else (False, "no dictionary is named: spelling is not checked")


def read_file(path: str, section: str = "quarry") -> tuple[dict[str, Any], list[str]]:
    """(settings, unknown keys) of a TOML file, flat or under a section."""
    try:
        with open(path, "rb") as f:
            data = tomllib.load(f)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path} is no valid TOML: {e}") from e
    except OSError as e:
        raise ConfigError(f"{path} can't be read: {e}") from e
    data = data[section] if isinstance(data.get(section), dict) else data
    known = {f.name: f for f in fields(Config) if f.name != "extra"}
    return {k: v for k, v in data.items() if k in known}, sorted(k for k in data if k not in known)


def resolve(*layers: dict[str, Any]) -> Config:
    """A Config of layers of settings, later ones over earlier ones; None is no setting."""
    kinds = {f.name: type(f.default) for f in fields(Config) if f.name != "extra"}
    merged: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            if v is None or k not in kinds:
                continue
            want = kinds[k]
            if want is tuple:
                ok, v = isinstance(v, (list, tuple)), tuple(map(str, v)) if isinstance(v, (list, tuple)) else v
            elif want is float:
                ok, v = isinstance(v, (int, float)) and not isinstance(v, bool), float(v) if isinstance(v, (int, float)) else v
            else:
                ok = isinstance(v, want) and (want is bool or not isinstance(v, bool))
            if not ok:
                raise ConfigError(f"{k} should be of kind {'list' if want is tuple else want.__name__}, not {v!r}")
            merged[k] = v
    return Config(**merged)
