"""Tables: the snapshot of responses that stands for the network, and the state that a crawl builds."""

from __future__ import annotations

RESPONSE = (
    "url string, status int, location string, content_type string, content_length long, headers map<string,string>, "
    "body binary, fetched_at timestamp, rendered_html string, network_images array<string>, json_images array<string>"
)
PAGE = (
    "page_id long, url string, kind string, depth int, discovered_from long, pattern string, state string, skip_reason string, "
    "status int, final_url string, content_type string, rendered boolean, fetched_at timestamp, error string"
)
IMAGE_URL = (
    "image_id long, url string, state string, skip_reason string, sha256 string, final_url string, status int, content_type string, "
    "headers string, url_filename string, source string, fetched_at timestamp, error string"
)
FILE = "sha256 string, path string, bytes long, format string, first_seen timestamp"
OCCURRENCE = "image_id long, page_id long, kind string, context string"
RUN = "run_id long, started_at timestamp, ended_at timestamp, status string, engine_version string"
STATE = {"page": PAGE, "image_url": IMAGE_URL, "file": FILE, "occurrence": OCCURRENCE}

#: What the columns of the state may hold.
PAGE_KINDS = ("page", "sitemap", "css", "manifest", "browserconfig")
STATES = ("queued", "in_progress", "done", "failed", "skipped")
SOURCES = ("live", "wayback", "wayback-archive", "data-uri", "list")
RUN_STATES = ("new", "running", "finished", "limit", "interrupted", "dry_run")
