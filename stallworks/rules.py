"""Fixed values.

The word lists, markers, weights and limits below are data, not logic: results
only agree with the expected ones when these values are exactly so.  Every
function that uses one takes it from here, so a deployment can override a list
in one place.
"""

# --- fixed values: URLs -----------------------------------------------------

PAGE_PARAMS = ["page", "pageindex", "p", "pg", "paged", "page_num", "pageid", "pagenum", "page_no"]
ID_KEYS = ["id", "companyid", "exhibitorid", "vendorid", "listingid", "profileid", "recordid"]
SOCIAL_HOSTS = [
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "youtu.be",
    "pinterest.com", "tiktok.com", "threads.net", "wechat.com", "wa.me", "whatsapp.com",
]
NON_COMPANY_HOSTS = [
    "acuityscheduling.com", "calendly.com", "eventbrite.com", "linktr.ee", "stan.store", "taplink.cc", "zendesk.com",
]
NON_COMPANY_PATHS = ["/hc/", "/help", "/schedule.php"]
NON_BRAND_HOST_PREFIXES = ["app.", "help.", "support.", "events."]
EVENT_HOSTS = ["eventscribe.net", "expofp.com", "mapyourshow.com", "myexpoonline.com"]
EVENT_PATHS = ["eventmap", "floorplan", "floor-plan", "mapitbooth", "showrooms"]
EVENT_QUERY_KEYS = ["boothid", "eventid", "hallid", "mapid", "shmode"]
EVENT_TEXTS = ["booth", "event map", "find us", "floor plan", "floorplan", "map", "showroom", "view booth"]
ASSET_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "css", "js", "json", "xml", "pdf", "zip", "mp4", "mp3",
]
IMAGE_EXTENSIONS = ["bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp"]
HOST_LABEL_PREFIXES = ["go", "get", "shop", "store", "visit"]
PROFILE_PATHS = [
    "/co/", "/company", "/companies/", "/exhibitor", "/exhibitors/", "/member", "/members/", "/organization",
    "/organizations/", "/participant", "/participants/", "/partner", "/partners/", "/profile", "/profiles/",
    "/speaker", "/speakers/", "/sponsor", "/sponsors/", "/vendor", "/vendors/",
]
GALLERY_FILTER_PARAMS = [
    "featured", "alpha", "categories", "country", "state", "pavilion", "hall", "georegion", "search",
]
TRACKING_HOSTS = [
    "adnxs.com", "doubleclick.net", "googleadservices.com", "googlesyndication.com", "googletagmanager.com",
]
TRACKING_PATHS = ["/activityi", "/activity;", "/pagead/"]
PLATFORM_HOSTS = ["mapyourshow.com", "expofp.com", "swapcard.com"]

# --- fixed values: link and company texts -----------------------------------

GENERIC_LINK_TEXTS = [
    "about", "about us", "account", "add to cart", "add to mymarket", "all", "apply", "back", "blog", "browse",
    "calendar", "categories", "clear", "clear all filters", "close", "contact", "contact us", "directions",
    "download", "events", "faq", "filters", "forgot password", "help", "home", "hotels", "info", "learn more",
    "login", "log in", "logout", "menu", "my account", "my market", "next page", "news", "our story", "partners",
    "plan your trip", "previous page", "privacy policy", "products", "read more", "register", "registration",
    "search", "services", "show all", "sign in", "sign up", "skip to main content", "skip to navigation",
    "skip to footer", "sponsors", "travel planning", "view all", "view details",
]
PROFILE_LABELS = [
    "details", "explore", "learn more", "more details", "profile", "read more", "see more", "view",
    "view company", "view details", "view profile", "visit",
]
PAGINATION_TEXTS = [
    "next", "next page", "previous", "previous page", "prev", "older", "newer", "load more", "more",
]
REGION_WORDS = ["ca", "canada", "eu", "global", "na", "uk", "us", "usa", "worldwide"]
DOMAIN_STOPWORDS = [
    "and", "co", "company", "corp", "corporation", "group", "home", "homepage", "inc", "international", "intl",
    "llc", "llp", "ltd", "official", "site", "store", "the", "usa", "us", "website",
]
SITE_WORDS = ["home", "homepage", "official", "site", "store", "website"]
NAME_GENERIC_MARKERS = [
    "accessories", "bedding", "cabinet hardware", "decor", "exclusive materials", "furniture", "furnishings",
    "hardwood", "hardware", "home decor", "materials", "outdoor", "provide versatility", "rugs", "solid brass",
]
LOGO_MARKERS = ["logo", "monogram", "stacked", "square"]
CALL_TO_ACTION_MARKERS = [
    "exhibit", "exhibitor", "looking to exhibit", "list will continue", "secure your space", "to date",
]
FILTER_UI_MARKERS = [
    "clear filters", "product category", "destination sector", "country please choose", "newsletter",
]
UI_NOISE = (
    r"(?i)\b(?:search|cart|loader|close panel|chevron(?:-[a-z]+)?|design trade(?:\s*&\s*contract sales)?"
    r"|exclamation-circle|menu|open menu|x)\b.*$"
)
BOOTH_NOISE = r"(?i)\b(?:image|new exhibitor|featured exhibitor)\b.*$"
BOOTH_CODE = r"^([A-Z]{1,4}\d{1,4}[A-Z]?(?:[-/][A-Z0-9]+)?)\s+(.+)$"
DOMAIN_TEXT = r"(?i)^(?:https?://)?(?:www\.)?[a-z0-9][a-z0-9.-]+\.[a-z]{2,}(?:/.*)?$"
LINE_URL = r"(?i)(?:https?://)?(?:www\.)?[a-z0-9][a-z0-9.-]+\.[a-z]{2,}(?:/[^\s]*)?"
TITLE_SPLIT = "\\s*[|\\-:–—]\\s*"

# --- fixed values: conference names and places ------------------------------

DIRECTORY_LABELS = [
    "companies", "company directory", "conference directory", "directory", "directory listing",
    "event directory", "exhibitor", "exhibitor directory", "exhibitors", "listing", "listings",
    "sponsor directory", "sponsors", "vendor directory", "vendors",
]
DIRECTORY_LABEL_WORDS = ["exhibitor", "vendor", "company", "conference", "event"]
EVENT_WORDS = [
    "conference", "convention", "event", "expo", "fair", "forum", "market", "meeting", "show", "summit", "trade",
]
CONFERENCE_NOISE = (
    r"(?i)\b(?:see more links?|search(?:\s+for)?\s+all\s+(?:exhibitors?|vendors?|companies?|sponsors?))\b"
)
CONFERENCE_DIRECTORY = r"(?i)\b(?:exhibitor|vendor|company|sponsor)\s+directory\b"
HOST_SUFFIX_LABELS = ["www", "com", "org", "net", "io", "co", "us"]
REGIONS = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO",
    "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA",
    "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT",
    "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD",
    "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "alberta": "AB", "british columbia": "BC",
    "manitoba": "MB", "new brunswick": "NB", "newfoundland and labrador": "NL", "nova scotia": "NS",
    "ontario": "ON", "prince edward island": "PE", "quebec": "QC", "saskatchewan": "SK",
}
CITY_REGION = (
    r"\b([A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*){0,4})\s*,\s*"
    r"([A-Z]{2}|[A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*){0,3})\b"
)
LOCATION_HINTS = ["location", "venue", "show location", "held in", "city"]
LOCATION_MIN_SCORE = 60.0

# --- fixed values: directory discovery, images, embedded JSON ----------------

DISCOVERY_LABELS = [
    "brands", "exhibitor directory", "exhibitors", "participating brands", "participating exhibitors",
    "participating manufacturers", "participating partners", "participating sponsors", "participating vendors",
    "partners", "sponsors", "vendor directory", "vendors",
]
DISCOVERY_WORDS = ["brand", "directory", "exhibitor", "manufacturer", "partner", "sponsor", "vendor"]
LISTING_GROUP_WORDS = ["exhibitor", "vendor", "profile", "company", "listing", "sponsor", "showroom"]
IMAGE_WORDS = ["brand", "directory", "exhibitor", "lineup", "list", "participant", "sponsor", "vendor"]
IMAGE_NOISE = ["banner", "hero", "icon", "logo", "nav", "thumbnail"]
META_WEIGHTS = {
    "og:site_name": 170.0, "application-name": 160.0, "apple-mobile-web-app-title": 155.0, "og:title": 95.0,
    "twitter:title": 85.0,
}
JSON_LD_NAMES = ["name", "alternateName", "legalName"]
JSON_LD_WEIGHTS = {
    "brand": 180.0, "organization": 175.0, "corporation": 170.0, "localbusiness": 165.0, "store": 160.0,
    "website": 150.0, "webpage": 70.0,
}
LIST_KEY_WORDS = [
    "companies", "company", "directory", "exhibitor", "exhibitors", "listing", "listings", "organization",
    "organizations", "organisation", "organisations", "partner", "partners", "profile", "profiles", "sponsor",
    "sponsors", "vendor", "vendors",
]
COMPANY_TYPE_WORDS = ["company", "exhibitor", "sponsor", "vendor"]
NAME_KEYS = [
    "companyname", "companytitle", "displayname", "exhibitorname", "label", "name", "organizationname",
    "organisationname", "partnername", "publicname", "sponsorname", "title", "vendorname",
]
PROFILE_URL_KEYS = [
    "detailsurl", "href", "link", "path", "profilelink", "profilepath", "profileurl", "publicurl", "url",
]
WEBSITE_KEYS = [
    "businesswebsite", "companyurl", "companywebsite", "contactwebsite", "contacturl", "externalurl", "homepage",
    "publicwebsite", "website", "websiteurl",
]
EVENT_SLUG_KEYS = ["eventSlug", "activeEventSlug", "slug"]
TITLE_KEYS = ["title", "eventTitle", "eventName", "conferenceName", "name"]
STATE_VARIABLES = ["__INITIAL_STATE__", "__PRELOADED_STATE__", "__APOLLO_STATE__", "__data"]
EMBEDDED_WEBSITE_FIELDS = ["websiteValue"]
TOTAL_PAGE_PATTERNS = [
    r"(?i)\bPAGINATION_TOTAL\s*=\s*(\d+)\b",
    r'(?i)"totalPages"\s*:\s*(\d+)',
    r"(?i)\btotalPages\b['\"]?\s*[:=]\s*(\d+)",
    r"(?i)\bpageCount\b['\"]?\s*[:=]\s*(\d+)",
    r"(?i)\btotal_pages\b['\"]?\s*[:=]\s*(\d+)",
    r"(?i)\bpage_count\b['\"]?\s*[:=]\s*(\d+)",
]
NAVIGABLE_ATTRS = ["data-option-url", "data-href", "data-url", "data-link", "data-target-url", "formaction"]

# --- fixed values: limits ----------------------------------------------------

SUPPORT_WEIGHT = 3
SHORT_TEXT = 140
GALLERY_PAGE_SIZE = 50
MIN_EMBEDDED = 3
MIN_TABLE = 3
MIN_LINES = 10

# --- fixed values: schedule and campaign state --------------------------------

HEADER_ALIASES = {
    "show": "show", "event": "show", "conference": "show", "date": "date", "start date": "date",
    "place": "place", "location": "place", "link": "link", "url": "link", "directory url": "link",
}
DATED_FORMATS = ["yyyy-M-d", "M/d/yyyy", "M/d/yy", "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy"]
YEARLESS_FORMATS = ["MMM d", "MMMM d", "MMM d,", "MMMM d,"]
RUN_OFFSET_DAYS = 14
RUN_HOUR = 9
YEARLESS_GRACE_DAYS = 30
SHOW_STATUSES = ["waiting", "queued", "scraping", "ready_for_review", "approved", "live", "failed"]
RUN_STATUSES = ["queued", "running", "success", "failed"]
PROVIDER_STATUSES = ["pending", "skipped", "success", "failed"]
TRANSITIONS = [
    ("waiting", "queued"), ("ready_for_review", "queued"), ("approved", "queued"), ("live", "queued"),
    ("failed", "queued"), ("queued", "scraping"), ("scraping", "ready_for_review"), ("scraping", "failed"),
    ("ready_for_review", "approved"), ("approved", "approved"), ("waiting", "approved"), ("queued", "approved"),
    ("scraping", "approved"), ("live", "approved"), ("failed", "approved"), ("approved", "live"),
]
