"""Column expressions over request URIs."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Resource class by file extension.
EXTENSIONS = {
    ".html": "html", ".htm": "html", ".php": "html", ".asp": "html", ".aspx": "html", ".jsp": "html",
    ".json": "api",
    ".js": "script", ".mjs": "script", ".wasm": "script",
    ".css": "style", ".map": "style",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".gif": "image", ".svg": "image", ".webp": "image",
    ".avif": "image", ".ico": "image", ".bmp": "image", ".tif": "image", ".tiff": "image",
    ".woff": "font", ".woff2": "font", ".ttf": "font", ".otf": "font", ".eot": "font",
    ".mp4": "media", ".webm": "media", ".mov": "media", ".avi": "media", ".mp3": "media", ".wav": "media",
    ".ogg": "media", ".m4a": "media",
    ".pdf": "document", ".txt": "document", ".csv": "document", ".xml": "document", ".doc": "document",
    ".docx": "document", ".xls": "document", ".xlsx": "document", ".ppt": "document", ".pptx": "document",
    ".zip": "archive", ".gz": "archive", ".br": "archive", ".tar": "archive", ".rar": "archive", ".7z": "archive",
}

#: Media types of further extensions in the public registry of media types, pinned so that results don't depend
#: on the machine.
MEDIA_TYPES = {
    ".xht": "application/xhtml+xml", ".xhtml": "application/xhtml+xml", ".shtml": "text/html",
    ".geojson": "application/geo+json", ".jsonld": "application/ld+json", ".webmanifest": "application/manifest+json",
    ".ecma": "application/ecmascript",
    ".apng": "image/apng", ".cgm": "image/cgm", ".djvu": "image/vnd.djvu", ".dng": "image/x-adobe-dng", ".emf": "image/emf",
    ".heic": "image/heic", ".heif": "image/heif", ".jfif": "image/jpeg", ".jp2": "image/jp2", ".jpe": "image/jpeg", ".jxl": "image/jxl",
    ".pbm": "image/x-portable-bitmap", ".pcx": "image/vnd.zbrush.pcx", ".pgm": "image/x-portable-graymap", ".pnm": "image/x-portable-anymap",
    ".ppm": "image/x-portable-pixmap", ".psd": "image/vnd.adobe.photoshop", ".svgz": "image/svg+xml", ".tga": "image/x-tga", ".wmf": "image/wmf",
    ".ttc": "font/collection",
    ".3gp": "video/3gpp", ".aac": "audio/aac", ".aif": "audio/x-aiff", ".aiff": "audio/x-aiff", ".amr": "audio/amr", ".au": "audio/basic",
    ".flac": "audio/flac", ".flv": "video/x-flv", ".m3u": "audio/x-mpegurl", ".m4v": "video/x-m4v", ".mid": "audio/midi", ".midi": "audio/midi",
    ".mka": "audio/x-matroska", ".mkv": "video/x-matroska", ".mp2": "audio/mpeg", ".mpe": "video/mpeg", ".mpeg": "video/mpeg", ".mpg": "video/mpeg",
    ".oga": "audio/ogg", ".ogv": "video/ogg", ".opus": "audio/ogg", ".qt": "video/quicktime", ".ra": "audio/x-realaudio", ".weba": "audio/webm",
    ".wma": "audio/x-ms-wma", ".wmv": "video/x-ms-wmv",
    ".atom": "application/atom+xml", ".c": "text/x-csrc", ".conf": "text/plain", ".dtd": "application/xml-dtd", ".gpx": "application/gpx+xml",
    ".ics": "text/calendar", ".java": "text/x-java", ".kml": "application/vnd.google-earth.kml+xml", ".log": "text/plain", ".markdown": "text/markdown",
    ".md": "text/markdown", ".mml": "application/mathml+xml", ".py": "text/x-python", ".rdf": "application/rdf+xml", ".rss": "application/rss+xml",
    ".rtf": "text/rtf", ".sgml": "text/sgml", ".tex": "text/x-tex", ".tsv": "text/tab-separated-values", ".vcf": "text/vcard", ".vtt": "text/vtt",
    ".wsdl": "application/wsdl+xml", ".xsd": "application/xml", ".xsl": "application/xslt+xml", ".xslt": "application/xslt+xml",
    ".dotx": "application/vnd.openxmlformats-officedocument.wordprocessingml.template",
    ".ppsx": "application/vnd.openxmlformats-officedocument.presentationml.slideshow",
    ".xltx": "application/vnd.openxmlformats-officedocument.spreadsheetml.template",
    ".epub": "application/epub+zip", ".tgz": "application/gzip",
}


def media_class(media_type: str) -> str | None:
    """Resource class of a media type, None if it has none."""
    m = media_type.lower()
    rules = (
        (m.startswith("text/html"), "html"),
        ("json" in m, "api"),
        (any(x in m for x in ("javascript", "ecmascript", "wasm")), "script"),
        (m.startswith("text/css"), "style"),
        (m.startswith("image/"), "image"),
        (m.startswith("font/"), "font"),
        (m.startswith(("audio/", "video/")), "media"),
        ("pdf" in m or "xml" in m or m.startswith("text/"), "document"),
        (any(x in m for x in ("zip", "gzip", "x-tar", "x-7z")), "archive"),
    )
    return next((name for yes, name in rules if yes), None)


def endpoint_path(uri: Column) -> Column:
    """The path of a request URI, percent-decoded, without query.

    A rooted path or an absolute URI with a path gives that path; a request URI has no fragment, so `#` stays in it. What
    doesn't parse (a bad escape, a relative path, no path) is cut at the first `?` or `#` and left as it is. Blank: empty.
    """
    u = F.trim(uri)
    absolute = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?]*)", 1)
    path = F.when(F.startswith(u, F.lit("/")), F.substring_index(u, "?", 1)).otherwise(absolute)
    decoded = F.when(F.contains(path, F.lit("%")), F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)
    rest = F.substring_index(F.substring_index(u, "?", 1), "#", 1)
    return F.when(u == "", F.lit("")).when((path != "") & decoded.isNotNull() & ~u.rlike(r"[\x00-\x1f\x7f ]"), decoded).otherwise(rest)


def extension(path: Column) -> Column:
    """From the last dot of the last segment, lower-cased; empty if there is none."""
    last = F.substring_index(path, "/", -1)
    return F.when(~F.contains(last, F.lit(".")), F.lit("")).otherwise(F.lower(F.concat(F.lit("."), F.substring_index(last, ".", -1))))


def is_api_path(path: Column) -> Column:
    # Most paths are told by their first two characters, without the pattern.
    return (F.startswith(path, F.lit("/a")) | F.startswith(path, F.lit("/g"))) & path.rlike("^/(api|ajax|graphql)(/|$)")


def resource_type(uri: Column) -> Column:
    """One of the ten resource classes. API paths win over extensions; a path without extension is a page."""
    return endpoint_resource_type(endpoint_path(uri))


def endpoint_resource_type(endpoint: Column) -> Column:
    """resource_type of an endpoint_path; cheaper over one that is a column, for it is named several times."""
    path = F.lower(endpoint)
    by_media = {e: c for e, m in MEDIA_TYPES.items() if (c := media_class(m))}
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable((EXTENSIONS | {e: c for e, c in by_media.items() if e not in EXTENSIONS} | {"": "html"}).items())])
    return F.when(path == "", "other").when(is_api_path(path), "api").when(~F.contains(path, F.lit(".")), "html").otherwise(F.coalesce(F.try_element_at(table, extension(path)), F.lit("other")))
