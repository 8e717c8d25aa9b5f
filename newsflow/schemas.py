"""Row types of the library. Times are UTC; `seq` is the order of arrival, which breaks every tie."""

RAW_ITEM = "seq bigint, url string, title string, summary string, published_at timestamp, source_domain string, feed_domain string"
ARTICLE = "url string, domain string, source_name string, title string, snippet string, published_at timestamp, found_at timestamp, matched_keywords array<string>, body string"
SOURCE_MODE = "domain string, mode string"
SOURCE_KEYWORD = "domain string, keyword string"
CONFIG = "key string, value string"
RUN = "id bigint, started_at timestamp, finished_at timestamp, n_found int, errors array<string>"
PUBLICATION = "rank int, title string, pdf_url string, report_url string, updated_at timestamp"
BLOCK = "type string, text string, bold boolean, src string"
DIGEST_REQUEST = "pos int, url string, take string, sector string"
DOM_ITEMS = "array<struct<t:string,v:string,lis:array<string>,src:string,alt:string,idx:int>>"
