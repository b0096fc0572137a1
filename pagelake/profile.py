"""Site profiles: the selectors, labels, patterns and keys an operator needs.

A profile is plain data.  Markup selectors are written as *start-tag
patterns* (Java regex fragments that match an element's opening tag), so
extraction stays inside built-in regex expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class SiteProfile:
    base_url: str | None = None
    # --- scope (regex *search* on the URL-decoded path?query) -------------
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    # query keys dropped while canonicalising (session / tracking only)
    strip_query_keys: tuple[str, ...] = ()
    # --- markup: start-tag patterns -----------------------------------------
    token_attr: str = "data-csrf"
    endpoint_attr: str = "data-endpoint"
    breadcrumb_block: str = r'<ul[^>]*class="[^"]*\bbreadcrumb\b[^"]*"[^>]*>'
    breadcrumb_end: str = r"</ul>"
    forum_crumb_block: str = r'<ul[^>]*class="[^"]*\bforum-crumbs\b[^"]*"[^>]*>'
    topic_title_tag: str = r'<h1[^>]*class="[^"]*\btopic-title\b[^"]*"[^>]*>'
    nav_block: str = r"<nav\b[^>]*>"
    nav_end: str = r"</nav>"
    paginator_block: str = r'<ul[^>]*class="[^"]*\bpager\b[^"]*"[^>]*>'
    paginator_end: str = r"</ul>"
    # item of the paginator; None: its last link is the next page
    paginator_item: str | None = r"<li(?=[\s>])"
    attachment_class: str = "attachment"
    attachment_block: str | None = r'<div[^>]*class="[^"]*\battachments\b[^"]*"[^>]*>'
    post_tag: str = "li"
    post_start: str = r'<li[^>]*class="[^"]*\bpost\b[^"]*"'
    post_id_attr: str = "data-post-id"
    post_header: str = r'<div[^>]*class="[^"]*\bpost-byline\b[^"]*"[^>]*>'
    post_info: str = r'<div[^>]*class="[^"]*\bpost-info\b[^"]*"[^>]*>'
    post_body: str = r'<div[^>]*class="[^"]*\bpost-body\b[^"]*"[^>]*>'
    email_token_attr: str = "data-mail-token"
    email_vector_attr: str = "data-mail-vector"
    group_start: str = r'<li[^>]*class="[^"]*\bcat-group\b[^"]*"'
    category_start: str = r'<li[^>]*class="[^"]*\bcat-item\b[^"]*"'
    category_id_attr: str = "data-cat-id"
    upload_dirs: tuple[str, ...] = ("/files/", "/uploads/")
    strip_blocks: tuple[str, ...] = ()
    # --- labels inside post text ----------------------------------------
    author_sep: str = "by"
    label_updated: str = "Updated"
    label_role: str = "Role"
    mail_shift: int = -1
    # --- index / labels ---------------------------------------------------
    generic_title: str = r"^Welcome to the board$"
    site_suffix: str = r" \| Riverside board$"
    title_noise: str = r" \[\d+ (?:views|replies)\]$"
    # Layout of topic and category URLs.
    topic_url: str = r"/topic/(\d+)/page(?:/(\d+))?"
    category_url: str = r"/cat/(\d+)/page(?:/(\d+)|-(\d+))?"
    page_param: str | None = None
    category_seed: str = r"/cat/(\d+)/"
    # captures the id wherever a category's pages are named in a path
    category_id: str = r"/cat/(\d+)/"
    topic_pattern: str = "/topic/"
    # --- ledger -------------------------------------------------------------
    lease_timeout_sec: int = 300

    def with_(self, **kw) -> "SiteProfile":
        return replace(self, **kw)


# URLs of the test board that are not archived: actions and feeds (a "board" parameter with
# "do" or "as"), signing out, disk images.
FORUM_EXCLUDE = (r"board\[(do|as)\]=", r"[?&]signout=", r"\.iso$")
# Session and tracking query keys removed from URLs.
TRACKING_KEYS = (
    "FE_SESSION",
    "fe_typo_user",
    "PHPSESSID",
    "utm_source",
    "utm_medium",
    "utm_campaign",
)

# Profile used by the unit tests on own-written forum fixtures.
FORUM = SiteProfile(
    base_url="https://forum.example.org",
    include=(r"/board",),
    exclude=FORUM_EXCLUDE,
    strip_query_keys=TRACKING_KEYS,
    strip_blocks=(r'<div[^>]*class="[^"]*\blogin-frame\b[^"]*"[^>]*>',
                  r'<form[^>]*action="[^"]*signout[^"]*"[^>]*>'),
)

# Profile for the driver's generic article pages: nav anchors act as the
# breadcrumb and menu, the page <h1> as the topic title, the language segment
# as the category id and the last nav entry as the paginator.
ARTICLES = SiteProfile(
    base_url=None,
    include=(r"/en/", r"^/[^/]+$"),
    exclude=(r"/\d+\.html$",),
    strip_query_keys=TRACKING_KEYS,
    token_attr="lang",
    breadcrumb_block=r"<nav\b[^>]*>",
    breadcrumb_end=r"</nav>",
    forum_crumb_block=r"<nav\b[^>]*>",
    topic_title_tag=r"<h1\b[^>]*>",
    paginator_block=r"<nav\b[^>]*>",
    paginator_end=r"</nav>",
    paginator_item=None,
    upload_dirs=("/fr/",),
    strip_blocks=(r'<div class="ad">', r"<script\b[^>]*>"),
    generic_title=r"\*\*\*",
    site_suffix=r"\s*[-–]\s*Example\s*$",
    topic_url=r"^[a-z]+://[^/?#]+/[a-z]{2}/(\d+)(?:\.html)?(?:\?|$)",
    category_url=r"^[a-z]+://[^/?#]+/([a-z]{2})/\d+/(?:\?|$)",
    page_param=r"[?&]page=(\d+)",
    category_seed=r"^/([a-z]{2})/",
    category_id=r"/([a-z]{2})(?=/)",
    topic_pattern="/xx-topic/",
)
