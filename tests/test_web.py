import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from sparkseek.operators import extract as E
from sparkseek.sources.web import WebPages


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        found = self.path in ("/", "/a")
        self.send_response(200 if found else 404)
        self.send_header("ETag", '"1"')
        self.end_headers()
        if found:
            self.wfile.write(f"<h1>Page {self.path}</h1><p>é</p>".encode())

    def log_message(self, *args):
        pass


def test_pages_are_fetched_and_extracted(spark):
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(WebPages)
    rows = spark.read.format("web_pages").option("urls", f"{base}/ {base}/a {base}/gone http://127.0.0.1:1/").option("timeout", "2").load().cache()
    got = {r.url.removeprefix(base): (r.status, r.etag, r.html) for r in rows.collect()}
    server.shutdown()
    assert got["/a"] == (200, '"1"', "<h1>Page /a</h1><p>é</p>")
    assert got["/gone"][0] == 404 and got["http://127.0.0.1:1/"] == (None, None, None)
    pages = rows.where("status = 200").selectExpr("CAST(hash(url) AS LONG) AS page_id", "url", "html")
    assert {r.heading for r in E.sections(pages).collect()} == {"Page /", "Page /a"}
