"""Fixed values. They must equal the published feature definitions, so they are stated as plain text."""

# --- fixed values: hint strings looked for in the path -----------------------------------------
PHISH_HINTS = [
    "wp", "login", "includes", "admin", "content", "site", "images", "js", "alibaba", "css",
    "myaccount", "dropbox", "themes", "plugins", "signin", "view",
]

# --- fixed values: suffixes treated as suspicious ----------------------------------------------
SUSPICIOUS_TLDS = [
    "fit", "tk", "gp", "ga", "work", "ml", "date", "wang", "men", "icu", "online", "click",
    "country", "stream", "download", "xin", "racing", "jetzt", "ren", "mom", "party", "review",
    "trade", "accountants", "science", "ninja", "xyz", "faith", "zip", "cricket", "win",
    "accountant", "realtor", "top", "christmas", "gdn", "link", "asia", "club", "la", "ae",
    "exposed", "pe", "go.id", "rs", "k12.pa.us", "or.kr", "ce.ke", "audio", "gob.pe", "gov.az",
    "website", "bj", "mx", "media", "sa.gov.au",
]

# --- fixed values: link-shortener hosts (matched anywhere in the URL, case-sensitive) ------------
SHORTENER_HOSTS = [
    "bit.ly", "goo.gl", "shorte.st", "go2l.ink", "x.co", "ow.ly", "t.co", "tinyurl", "tr.im",
    "is.gd", "cli.gs", "yfrog.com", "migre.me", "ff.im", "tiny.cc", "url4.eu", "twit.ac", "su.pr",
    "twurl.nl", "snipurl.com", "short.to", "BudURL.com", "ping.fm", "post.ly", "Just.as",
    "bkite.com", "snipr.com", "fic.kr", "loopt.us", "doiop.com", "short.ie", "kl.am", "wp.me",
    "rubyurl.com", "om.ly", "to.ly", "bit.do", "lnkd.in", "db.tt", "qr.ae", "adf.ly", "bitly.com",
    "cur.lv", "tinyurl.com", "ity.im", "q.gs", "po.st", "bc.vc", "twitthis.com", "u.to", "j.mp",
    "buzurl.com", "cutt.us", "u.bb", "yourls.org", "prettylinkpro.com", "scrnch.me",
    "filoops.info", "vzturl.com", "qr.net", "1url.com", "tweez.me", "v.gd", "link.zip.net",
]

# --- fixed values: hosts and addresses of the statistical-report rule ----------------------------
REPORTED_HOSTS = [
    "at.ua", "usa.cc", "baltazarpresentes.com.br", "pe.hu", "esy.es", "hol.es", "sweddy.com",
    "myjino.ru", "96.lt", "ow.ly",
]
REPORTED_IPS = [
    "146.112.61.108", "213.174.157.151", "121.50.168.88", "192.185.217.116", "78.46.211.158",
    "181.174.165.13", "46.242.145.103", "121.50.168.40", "83.125.22.219", "46.242.145.98",
    "107.151.148.44", "107.151.148.107", "64.70.19.203", "199.184.144.27", "107.151.148.108",
    "107.151.148.109", "119.28.52.61", "54.83.43.69", "52.69.166.231", "216.58.192.225",
    "118.184.25.86", "67.208.74.71", "23.253.126.58", "104.239.157.210", "175.126.123.219",
    "141.8.224.221", "10.10.10.10", "43.229.108.32", "103.232.215.140", "69.172.201.153",
    "216.218.185.162", "54.225.104.146", "103.243.24.98", "199.59.243.120", "31.170.160.61",
    "213.19.128.77", "62.113.226.131", "208.100.26.234", "195.16.127.102", "195.16.127.157",
    "34.196.13.28", "103.224.212.222", "172.217.4.225", "54.72.9.51", "192.64.147.141",
    "198.200.56.183", "23.253.164.103", "52.48.191.26", "52.214.197.72", "87.98.255.18",
    "209.99.17.27", "216.38.62.18", "104.130.124.96", "47.89.58.141", "54.86.225.156",
    "54.82.156.19", "37.157.192.102", "204.11.56.48", "110.34.231.42",
]
UNRESOLVED_SENTINEL_IP = "125.235.4.59"

# --- fixed values: patterns of the URL rules -----------------------------------------------------
HAS_IP_PATTERN = r"(?:[a-fA-F0-9]{1,4}:){7}[a-fA-F0-9]{1,4}|[0-9a-fA-F]{7}"
HAS_PORT_PATTERN = (
    r"^[a-z][a-z0-9+\-.]*://([a-z0-9\-._~%!$&'()*+,;=]+@)?"
    r"([a-z0-9\-._~%]+|\[[a-z0-9\-._~%!$&'()*+,;=:]+\]):([0-9]+)"
)
ABNORMAL_SUBDOMAIN_PATTERN = r"(http[s]?://(w[w]?|[0-9]))([w]?([0-9]|-))"
PREFIX_SUFFIX_PATTERN = r"https?://[^\-]+-[^\-]+/"
VALID_URL_PATTERN = r"^https?://[^\s/$.?#].[^\s]*$"
WORD_SEPARATORS = r"[-./?=@&%:_]"

# --- fixed values: single characters counted over the whole URL, by output column ----------------
URL_CHARACTER_COUNTS = {
    "nb_fragments": "#", "nb_and": "&", "nb_dots": ".", "nb_hyphens": "-", "nb_at": "@",
    "nb_exclamation": "?", "nb_or": "|", "nb_equal": "=", "nb_underscore": "_",
    "nb_percentage": "%", "nb_slash": "/", "nb_star": "*", "nb_colon": ":", "nb_comma": ",",
    "nb_semicolumn": ";", "nb_dollar": "$",
}

# --- fixed values: phrases that mark a page as an error or placeholder page -----------------------
ERROR_PHRASES = [
    "page not found", "404", "not found", "error", "cloudflare", "firebase hosting",
    "github pages", "access denied", "forbidden", "unauthorized", "service unavailable",
    "maintenance", "coming soon", "domain for sale", "parked domain", "suspended",
]
SOCIAL_SITES = ["facebook", "twitter", "instagram", "linkedin", "youtube", "tiktok"]
AD_KEYWORDS = ["advertisement", "sponsored", "ad", "banner"]

# --- fixed values: output columns that count tags -------------------------------------------------
TAG_COUNTS = {
    "nb_forms": ["form"], "nb_inputs": ["input"], "nb_buttons": ["button"],
    "nb_selects": ["select"], "nb_textareas": ["textarea"], "nb_imgs": ["img"],
    "nb_embeds": ["embed"], "nb_audios": ["audio"], "nb_videos": ["video"],
    "nb_scripts": ["script"], "nb_a": ["a"], "nb_links": ["link"], "nb_iframes": ["iframe"],
    "nb_divs": ["div"], "nb_spans": ["span"], "nb_paragraphs": ["p"],
    "nb_headings": ["h1", "h2", "h3", "h4", "h5", "h6"], "nb_tables": ["table"],
    "nb_table_rows": ["tr"], "nb_table_cells": ["td", "th"], "nb_ul_lists": ["ul"],
    "nb_ol_lists": ["ol"], "nb_list_items": ["li"], "nb_strongs": ["strong"], "nb_ems": ["em"],
    "nb_canvas": ["canvas"], "nb_svgs": ["svg"], "nb_metas": ["meta"], "nb_styles": ["style"],
}

# --- fixed values: output column order of the dataset --------------------------------------------
URL_FEATURE_COLUMNS = [
    "url_len", "hostname_len", "entropy", "nb_fragments", "nb_dots", "nb_hyphens", "nb_at",
    "nb_exclamation", "nb_and", "nb_or", "nb_equal", "nb_underscore", "nb_tilde", "nb_percentage",
    "nb_slash", "nb_dslash", "nb_star", "nb_colon", "nb_comma", "nb_semicolumn", "nb_dollar",
    "nb_space", "nb_http_token", "nb_subdomain", "nb_www", "nb_com", "nb_redirection",
    "nb_e_redirection", "nb_phish_hints", "has_ip", "has_https", "has_punnycode", "has_port",
    "has_tld_in_path", "has_tld_in_subdomain", "has_abnormal_subdomain", "has_prefix_suffix",
    "has_short_svc", "has_path_txt_extension", "has_path_exe_extension", "has_domain_in_brand",
    "has_brand_in_path", "has_sus_tld", "has_statistical_report", "word_raw_len", "char_repeat",
    "shortest_word_raw_len", "shortest_word_raw_host_len", "shortest_word_raw_path_len",
    "longest_word_raw_len", "longest_word_raw_host_len", "longest_word_raw_path_len",
    "avg_word_raw_len", "avg_word_raw_host_len", "avg_word_raw_path_len", "ratio_digits_url",
    "ratio_digits_host",
]
PAGE_FEATURE_COLUMNS = [
    "is_alive", "is_empty_title", "nb_forms", "nb_inputs", "nb_buttons", "nb_selects",
    "nb_textareas", "nb_imgs", "nb_embeds", "nb_audios", "nb_videos", "nb_scripts", "nb_a",
    "nb_links", "nb_iframes", "nb_divs", "nb_spans", "nb_paragraphs", "nb_headings", "nb_tables",
    "nb_table_rows", "nb_table_cells", "nb_ul_lists", "nb_ol_lists", "nb_list_items",
    "nb_strongs", "nb_ems", "nb_canvas", "nb_svgs", "nb_metas", "nb_styles", "nb_special_char",
    "nb_ext_links", "nb_ext_scripts", "nb_ext_imgs", "nb_input_types", "nb_social_media_links",
    "nb_social_buttons", "content_txt_len", "body_len", "script_len", "has_onclick",
    "has_onmouse", "has_onload", "has_popup", "has_right_click", "has_password_field",
    "has_file_upload", "has_ssl", "has_captcha", "has_login_form", "has_date_stamps",
    "has_new_badges", "has_copyright_year", "has_social_sharing", "has_ad_keywords",
    "has_sus_ad_class", "has_popup_ad", "has_comment_sections", "has_rating_system",
    "has_search_box", "has_view_port_meta", "has_responsive_imgs", "has_mobile_css",
    "avg_sentence_len", "avg_words_per_sentence", "avg_paragraph_len", "readability_score",
    "txt_to_html_ratio", "txt_to_tag_ratio", "link_density", "img_density", "form_complexity",
    "unique_words_ratio", "punctuation_density",
]
DOMAIN_FEATURE_COLUMNS = [
    "whois_reg_domain", "domain_reg_len", "domain_age", "dns_record", "google_index", "page_rank",
]

# --- fixed values: crawler field names whose dataset name differs ---------------------------------
CRAWL_FIELD_NAMES = {
    "content_txt_len": "inner_text_len", "body_len": "body_length",
    "script_len": "script_length", "has_onclick": "elements_with_onclick",
    "has_onmouse": "elements_with_onmouse", "has_onload": "elements_with_onload",
    "has_popup": "has_popup_window", "nb_ext_links": "nb_external_links",
    "nb_ext_scripts": "nb_external_scripts", "nb_ext_imgs": "nb_external_images",
}

# Small default public-suffix rule list; callers pass the list of their choice.
DEFAULT_SUFFIX_RULES = [
    "com", "org", "net", "io", "edu", "gov", "info", "biz", "co", "uk", "co.uk", "br", "com.br",
    "de", "fr", "es", "it", "nl", "ru", "us", "ua", "at", "vn", "com.vn", "eu", "me",
] + SUSPICIOUS_TLDS
