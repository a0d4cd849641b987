"""Messages made for the tests."""

SIMPLE = "From: Alice <alice@example.com>\r\nTo: Bob <bob@example.com>\r\nSubject: Hello\r\nDate: Mon, 10 Feb 2026 10:30:00 +0000\r\nMessage-ID: <m1@example.com>\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nHi Bob,\r\n\r\nShall we meet?\r\n\r\nBest,\r\nAlice\r\n"
REPLY = "From: Bob <bob@example.com>\r\nTo: Alice <alice@example.com>\r\nCc: \r\nSubject: Re: Hello\r\nDate: Mon, 10 Feb 2026 12:00:00 +0100\r\nMessage-ID: <m2@example.com>\r\nIn-Reply-To: <m1@example.com>\r\nReferences: <m0@example.com>\r\n  <m1@example.com>\r\n\r\nYes, on Tuesday.\r\n\r\nOn Mon, Feb 10, 2026 at 10:30 AM Alice <alice@example.com> wrote:\r\n> Hi Bob,\r\n>\r\n> Shall we meet?\r\n"
NESTED = """From: =?ISO-8859-1?Q?J=FCrgen_R=F6?= =?utf-8?b?w6lz?= <j@example.com>
To: undisclosed, "Roe, Ann" <ann@example.com>
Subject: =?utf-8?B?Q2Fmw6k=?=
Date: Sat, 8 Nov 2025 14:04:26 +0100 (CET)
Content-Type: multipart/mixed; boundary="outer"

--outer
Content-Type: multipart/alternative; boundary="inner"

--inner
Content-Type: text/plain; charset="windows-1252"
Content-Transfer-Encoding: quoted-printable

plain =80
--inner
Content-Type: text/html; charset=utf-8
Content-Transfer-Encoding: base64

PHA+SGVsbG8gPGI+d29ybGQ8L2I+ITwvcD4
--inner--
--outer
Content-Type: text/html; name=a.html
Content-Disposition: attachment; filename=a.html

<p>attached</p>
--outer--
"""
GMAIL = """From: Dana <dana@example.com>
Subject: Re: Room
MIME-Version: 1.0
Content-Type: text/html; charset=utf-8

<div dir="ltr">Hello Max,<br><br>that works.<div>Kind regards,<br>Dana</div></div><div class="gmail_quote gmail_quote_container"><div dir="ltr" class="gmail_attr">Am Fr., 27. Feb. 2026 um 11:53 Uhr schrieb Max Roe &lt;<a href="mailto:max@example.com">max@example.com</a>&gt;:<br></div><blockquote class="gmail_quote"><div>Great, thanks.<br>One line.</div><br>- a question<div class="gmail_signature">Max</div><div class="gmail_quote"><div class="gmail_attr">On Thu, 26 Feb 2026 at 9:16, Dana &lt;dana@example.com&gt; wrote:</div><blockquote><p>We have a room.</p></blockquote></div></blockquote></div>
"""


def plain(body: str) -> str:
    return f"From: A <a@example.com>\nSubject: s\n\n{body}"
