"""Attack signatures: rules with their patterns, and the literals that a target must have for any rule to be tried."""

# Rules as (id, category, severity, score, title, description, patterns).
RULES = [
    ("sqli", "sql_injection", "critical", 95, "SQL injection payload", "Request target contains SQL injection indicators.", [
        r"\bunion\s+select\b", r"\binformation_schema\b", r"\bsleep\s*\(", r"\bbenchmark\s*\(", r"\bwaitfor\s+delay\b", r"\bprepare\s+stmt\b", r"\bexecute\s+stmt\b",
        r"[=(,]\s*0x[0-9a-f]{20,}", r"(?:'|%27)\s*(?:or|and)\s+1\s*=\s*1", r"\bpg_sleep\s*\(", r"\bversion\s*\(\s*\)", r"\bdatabase\s*\(\s*\)", r"\buser\s*\(\s*\)",
        r"\bconnection_id\s*\(\s*\)", r"/\*(?:\d+|\s*)\*/", r"(?:'|%27)\s*--", r"\)\s*--\s", r"\d\s*--\s", r"(?:'|%27)\s*#", r"\bunion\s*\(\s*select",
        r"\b(?:substring|substr|mid|concat|group_concat|cast)\s*\(",
    ]),
    ("xss", "xss", "high", 85, "XSS payload", "Request target contains script or browser execution indicators.", [
        r"<script", r"%3cscript", r"\bonerror\s*=", r"\bonload\s*=", r"javascript:", r"%3csvg", r"\balert\s*\(", r"document\.cookie",
        r"\bon(?:mouseover|focus|focusin|click|pointerdown|animationstart|toggle|wheel|pointerover|beforeload|transitionend)\s*=",
        r"\beval\s*\(", r"\bsettimeout\s*\(", r"\bsetinterval\s*\(", r"\b(?:inner|outer)html\b", r"\binsertadjacenthtml\s*\(",
    ]),
    ("lfi_rfi", "path_traversal", "high", 85, "LFI/RFI or path traversal payload", "Request target contains local/remote file inclusion indicators.", [
        r"\.\./", r"\.\.%2f", r"%252e%252e", r"\.\.\\", r"\.\.%5c", r"/etc/passwd", r"/etc/shadow", r"/etc/sudoers", r"/proc/self/environ", r"/proc/self/cmdline",
        r"php://filter", r"php://input", r"php://fd", r"phar://", r"(?:file|path|template)=https?://",
    ]),
    ("ssrf", "ssrf", "high", 80, "SSRF target", "Request target references metadata, localhost, or internal callback targets.", [
        r"169\.254\.169\.254", r"metadata\.google\.internal", r"(?:127\.0\.0\.1|localhost|0\.0\.0\.0)",
        r"(?:url|uri|callback|webhook|next|redirect|dest|target|feed|host|domain)=https?://(?:127\.0\.0\.1|localhost|0\.0\.0\.0|169\.254\.|10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|\[::1\]|metadata\.)",
    ]),
    ("command_injection", "command_injection", "critical", 95, "Command injection payload", "Request target contains shell metacharacters with command execution indicators.", [
        r"(?:;|%3b|\||%7c|`|%60|\$\(|%24%28).*(?:\bid\b|\bwhoami\b|\bcat\b|\bwget\b|\bcurl\b|\bbash\b|\bnc\b|\bsh\b|\bpython\b|\bperl\b|\bphp\b|\bping\b|\bnslookup\b|\bbase64\b|\bxxd\b|\bopenssl\b)",
        r"(?:;|%3b|\||%7c|`|%60|\$\(|%24%28).*(?:powershell|cmd\.exe|wscript|cscript)", r"\$IFS|\$\{IFS\}|\r?\n[;|`$]",
    ]),
    ("recon_sensitive_file", "recon", "medium", 65, "Sensitive file probe", "Request target probes common sensitive files or application internals.", [
        r"/\.env(?:\.|\z|\?)", r"/\.env\.local(?:\z|\?)", r"/\.env\.production(?:\z|\?)", r"/\.git(?:/|\z|\?)", r"/\.git/head(?:\z|\?)", r"/\.git/config(?:\z|\?)", r"/\.svn/", r"/\.hg/",
        r"/\.bzr/", r"/composer\.json(?:\z|\?)", r"/vendor/(?:autoload\.php|composer/|phpunit/|bin/)", r"/phpinfo\.php(?:\z|\?)", r"\.(?:sql|bak|old|zip|tar\.gz|tar|7z|rar|orig|bkp)(?:\z|\?)",
        r"/\.ssh/id_rsa(?:\z|\?)", r"/\.kube/config(?:\z|\?)", r"/wp-config\.php(?:\z|\?)", r"/docker-compose\.yml(?:\z|\?)", r"/\.ds_store(?:\z|\?)",
    ]),
]
RARE_METHOD = ("rare_method", "http_anomaly", "medium", 55, "Rare HTTP method", "Request uses an uncommon HTTP method for public web traffic.")
COMMON_METHODS = ["GET", "POST", "HEAD", "OPTIONS", "PUT", "DELETE", "PATCH"]

# Literals of the gate.
GATE = """
select union information_schema sleep( benchmark( waitfor prepare execute 0x pg_sleep( version() database() user() connection_id() /**/ /*! -- # union( substring( substr( mid( concat(
group_concat( cast( <script %3cscript onerror onload javascript: %3csvg alert( document.cookie onmouseover onfocus onfocusin onclick onpointerdown onanimationstart ontoggle onwheel
onpointerover onbeforeload ontransitionend eval( settimeout( setinterval( innerhtml outerhtml insertadjacenthtml( ../ ..%2f %252e ..\\ ..%5c /etc/ /proc/ php:// phar:// file=http path=http
template=http 169.254 metadata.google localhost 127.0.0.1 0.0.0.0 url=http callback=http webhook=http redirect=http dest=http target=http feed=http host=http domain=http ; %3b | %7c ` %60
$( %24%28 $IFS ${IFS} %0a %0d%0a powershell cmd.exe base64 xxd openssl .env .git composer.json phpinfo .sql .bak .old .env.local .env.production .git/head .git/config .svn/ .hg/ .bzr/ .tar
.7z .rar .orig .bkp .ssh/id_rsa .kube/config wp-config.php docker-compose.yml .ds_store
""".split()
