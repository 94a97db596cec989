"""Settings of the engine; gaps and widths are in seconds."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The event vocabulary and the platforms.
EVENT_NAMES = (
    "search_results_view",
    "item_view",
    "photo_swipe",
    "seller_page_view",
    "contact_phone_show",
    "contact_chat_open",
    "contact_message_sent",
    "favorite_add",
    "login",
    "captcha_shown",
)
ENGAGEMENT = ("photo_swipe", "favorite_add", "login")
CONTACT = ("contact_phone_show", "contact_chat_open", "contact_message_sent")
DWELL_EVENTS = ("item_view", "search_results_view", "photo_swipe", "seller_page_view")
PLATFORMS = ("web", "desktop", "android", "ios")
WEB, MOBILE = ("web", "desktop"), ("android", "ios")
# One letter for each event name, in the order above.
EVENT_CODES = dict(zip(EVENT_NAMES, "SIPLHCMFGK"))
# Clients whose user agent begins with one of these and a slash are scripts.
SCRIPT_CLIENTS = ("curl", "Scrapy", "node-fetch", "python-requests", "python-urllib3", "Go-http-client")
BROWSERS = ("YaBrowser", "HeadlessChrome", "Firefox", "Chrome", "Safari")


@dataclass(frozen=True)
class Settings:
    session_gap: int = 1800
    fast_gaps: tuple[int, ...] = (2, 5, 10, 30)
    bin_widths: tuple[int, ...] = (60, 300, 1800)
    bin_names: tuple[str, ...] = ("b1m", "b5m", "b30m")
    pace_cuts: tuple[int, ...] = (3, 10, 30, 120)
    compression_cuts: tuple[int, ...] = (1, 5, 30, 300)
    round_gaps: tuple[int, ...] = (5, 10, 60)
    deep_page: int = 5
    top_bigrams: int = 25
    catalog_tops: tuple[tuple[str, int], ...] = (("item_location", 40), ("item_category", 20), ("search_query", 40))
    catalog_names: tuple[tuple[str, str], ...] = (("item_location", "shloc"), ("item_category", "shcat"), ("search_query", "shq"))
    screen: tuple[int, int] = (1920, 1080)
    coverage_hours: float = 24.0
    svd_min_docs: float = 20
    smoothing: float = 20.0
    target_recall: float = 0.70
    n_folds: int = 5
    app_name: str = "NativeApp"

    def scaled(self, factor: int) -> Settings:
        """The same settings for a log whose gaps are ``factor`` times as long."""
        up = lambda xs: tuple(x * factor for x in xs)
        return replace(self, session_gap=self.session_gap * 12, fast_gaps=(3600, 7200, 14400, 28800), bin_widths=(3600, 21600, 86400), pace_cuts=up(self.pace_cuts), compression_cuts=up(self.compression_cuts))


#: The test tables' gaps are hours, and the smallest have few visitors.
FIXTURE = replace(Settings().scaled(3600), svd_min_docs=5)
