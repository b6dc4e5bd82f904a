"""Path lists and path patterns."""

# Paths that scanners ask for.
FINGERPRINT_PATHS = """
/HNAP1 /boaform/admin/formLogin /manager/html /jenkins /actuator /actuator/health /actuator/env /actuator/metrics /owa/auth/logon.aspx /cgi-sys/defaultwebpage.cgi
/wp-config.php.bak /wp-config.php.old /server-status /server-info /phpmyadmin /phpMyAdmin /pma /admin.php /console /api/swagger /swagger /swagger-ui.html /swagger.json /openapi.json
/.aws/credentials /.docker/config.json /sftp-config.json /web.config /elmah.axd /.env /.git/config /.svn/entries /.DS_Store /vendor/phpunit/phpunit/src/Util/PHP/eval-stdin.php
/xmlrpc.php /wp-admin/install.php /login.action /jmx-console /solr/admin/info/system /_cat/indices /_cluster/health /redis/info /cgi-bin/luci /cgi-bin/test.cgi /shell
/debug/default/view /.vscode/sftp.json /config.json /backup.zip /db.sql /dump.sql /actuator/heapdump /jenkins/script
""".split()

# Paths that never count as targets, and entry pages.
STATIC_ASSET = r"(?i)\.(?:js|mjs|css|map|png|jpe?g|gif|svg|webp|avif|woff2?|ttf|otf|eot|ico|bmp|tiff?|mp3|mp4|webm|ogg|m4a|m4v|pdf)(?:\?|\z)"
CRAWLER_INFRA = r"(?i)^/(?:sitemap[^?]*\.xml|robots\.txt|feed(?:/|\z|\?)|rss(?:/|\z|\?)|\.well-known(?:/|\z|\?)|favicon\.ico)(?:\?|\z)"
ENTRY_PATHS = ["/", "/index", "/index.html", "/index.htm", "/home"]

# Click-tracking parameters.
TRACKING = (
    r"(?i)^(?:fbclid|gclid|gclsrc|dclid|msclkid|yclid|gbraid|wbraid|gad_\w+|srsltid|utm_\w+|_ga\w*|_gl|_gid|mc_eid|mc_cid|igshid|s_kwcid|ef_id|_|rand|random|cache|cachebuster|cb|ts|timestamp|time)\z"
)
