"""A text model of notices that stand where real text should: errors, script notices, filler.

Logistic regression on stems, pairs of stems and a few shapes, fitted on the labelled messages below: a bounded sample,
written from common phrasings of servers, frameworks and page builders. Messages are lower case, digits masked as 0.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# Labelled messages, one a line.
RESIDUE = """
404
404 not found
404 - file or directory not found
error 404: page not found
500
500 - internal server error
503 service unavailable
error
error 403
oops! something went wrong
oops, that page can't be found
not found
page not found
the requested url was not found on this server
the page you are looking for does not exist or has been moved
sorry, the page you requested could not be found. it may have been removed or renamed
we could not find what you asked for. go back to the home page or use the search
there is nothing here. try the search or go back
this page is no longer available at this address
internal server error
internal error
the server encountered an internal error and was unable to complete your request
an unexpected error occurred while processing your request. reference number 12-34
the application failed to complete the request. error id 5512
application error: a client-side exception has occurred
bad request
bad gateway
502 bad gateway
gateway timeout
504 gateway time-out: the upstream server did not respond in time
upstream request timeout
connection timed out: the host did not answer
service unavailable
the service is temporarily unavailable. try again later
the site is down for scheduled maintenance. it will be back soon
we are currently performing maintenance and will be back shortly
the server is down for repairs and will be back tomorrow
forbidden
access denied
you do not have permission to access this resource
you are not authorised to view this page. contact the administrator
permission denied: ask the site administrator for access
login required to view this page
your session has expired. please log in again
session timed out, sign in to continue
invalid token, your session has ended
no results found
no records found
no record exists for the given number
no data available for the selected id
error establishing a database connection
could not connect to database server
mysql error: too many connections
unable to connect to the database host db1
database query failed: table does not exist
sqlstate[hy000] [2002] connection refused
warning: include(): failed to open stream: no such file or directory in /home/site/page.php on line 12
warning: mysql_connect(): access denied for user in /var/www/config.php on line 4
notice: undefined variable: title in /srv/www/view.php on line 7
fatal error: uncaught exception in /app/index.php on line 33
fatal error: call to undefined function
parse error: syntax error, unexpected end of file in /var/www/html/page.php on line 3
java.lang.illegalstateexception at com.example.view.page.show(page.java:20)
java.io.ioexception: stream closed at app.main.run(210)
javax.servlet.servletexception: null pointer
nullpointerexception at view.render
system.web.httpexception: the file does not exist
traceback (most recent call last): file "app.py", line 10, in render
typeerror: cannot read properties of undefined
stack trace: at object.render
please enable javascript to view this page
please enable javascript in your browser to continue
you need to enable javascript to run this application
javascript is disabled in your browser. this page cannot be shown without it
this site requires javascript. turn it on and reload the page
this website works only with scripts enabled
this service works only if scripts are switched on
your browser does not support scripts, so the content cannot be displayed
scripting is disabled; the page needs scripts to be shown
scripts and cookies are required to open this site
checking your browser before accessing the site
please wait while we check your browser
verifying you are human. this may take a few seconds
loading
loading...
loading, please wait
loading content, please wait a moment
please wait...
lorem ipsum dolor sit amet, consectetur adipiscing elit
lorem ipsum
sed ut perspiciatis unde omnis iste natus.
tempor magna aliqua dolor elit veniam. quis nostrud ullamco laboris nisi.
cras mattis donec purus semper. nulla vitae risus lectus.
this is sample text. replace it with your own text
sample text used to show the layout of the page
your text here
enter your text here. click to edit this paragraph
click here to add your own text and write about your department
this is a placeholder paragraph, replace it with the content of the section
insert content here
dummy text
dummy entry
dummy entry 1. dummy entry 2
page under construction
this page is under preparation
coming soon
content to be added
content from field body
content of field title_1
todo
todo: add content
todo: write this section
tbd
untitled
untitled document
untitled page
new page
new page 1
new document 2
sample page
test page
heading 1
heading one
heading two
subheading goes here
undefined
null
null null
undefined undefined
nan
none none none
[object object]
xxx xxx xxx
xxxx xxxx xxxx xxxx
abc abc abc
abc test abc test
asdf asdf asdf
test test test
aaa aaa aaa
पृष्ठ नहीं मिला
यह पृष्ठ नहीं मिला। पता जाँचें
माँगा गया पृष्ठ उपलब्ध नहीं है
त्रुटि: पृष्ठ नहीं खुल सका
सर्वर त्रुटि, बाद में प्रयास करें
कृपया जावास्क्रिप्ट चालू करें
इस साइट के लिए ब्राउज़र में जावास्क्रिप्ट चालू होना चाहिए
यहाँ अपना पाठ लिखें
यह नमूना पाठ है
यह केवल एक नमूना है, अपना पाठ लिखें
"""

ORDINARY = """
home
home page
contact us
about us
site map
search
login
registration on the website is open until friday
students corner
departments and centres
photo gallery
notices and circulars
tenders and purchases
campus news
home > notices > results of the examination
home / departments / library
you may also like
quick links
recent notices
back to top
share this page: mail | print | copy link
privacy policy | terms of use | accessibility
screen reader access | skip to main content | a+ a a-
all rights reserved
© 2021 institute of technology
copyright 2019-2023 university of the north, computer centre
post box 12, phone 022-4455
campus road, post box 90, phone 01-2233
best viewed in a recent browser at 1024 x 768
designed and hosted by the computer centre
designed in house
last updated on 12 may 2021
this page was last modified on 01-02-2022
visitors so far: 20311
you are visitor no. 4431
webmaster: web team
posted by admin
posted by: media office
text: press unit, pictures: photo club
nodal officer for the site: web desk
helpline of the estate office: extension 44
we use cookies to improve your visit. accept all or manage settings
this site uses cookies. by staying you agree to their use
your privacy: essential and optional cookies. manage preferences
cookies help us count visitors. read the cookie policy or close this message
accept cookies
links to other sites are given for convenience only
unauthorised copying of material is prohibited under the terms of the site
figures shown here are for information only and create no claim
the printed version kept by the office is valid in case of doubt
the content of this page is maintained by the section concerned
follow us and never miss an update
subscribe to the newsletter
please use the search box to find a person
you need a valid identity card to enter the library
you are invited to the opening of the new gallery
the office could not be reached by road for two days
the seminar on javascript and web scripts is on monday
lecture on databases and query languages
a course on graph database design
report on web server logs
web server - workshop
notice 12/3: web server
the database of the library was moved to a new server in march
enable two-step login before the end of the term
the error of the instrument was measured twice and found to be small
the court found the accused not guilty
the missing page of the minutes was found in the archive
the session of the council was closed at noon
the session on error correction will continue on tuesday
sign in at the desk before the session
no complaints were received this year
no student may leave the hall before the bell
records of the given year are kept in the archive
maintenance of the pumps was completed in june
the road is closed for maintenance and will be open again on friday
access to the laboratory is given by the head
the administrator of the hostel keeps the register
permission to visit the site was given by the collector
loading of goods at the gate is allowed after ten
loading test of the bridge
the sample was heated and weighed
sample of soil and water
sample size and method
the text of the rules is given below
write your name and roll number on the form
the section heads met on monday and wrote a report
click on the link to read the notice
replace the filter every six months
the entry for the contest closes on 12 may
test of strength and endurance
test results of batch 3
the first test was held on monday, the second on friday
new hostel block
new entrants of 2021
page setup and printing
faculty page
staff page of the hostel
official page of the club
other page
page of notices
the next page of the album
heading of the report
the heading of the letter names the office
object of the society
null hypothesis and tests
undefined terms of geometry
construction of the north block
under the new rules the fee is due in july
results
results of the semester examination
computer networks - course abcde
notice abcde/12: soil erosion
special lecture on bank audit
planned handout on plant cells
joint exercise on fluid flow
physics: open review, light scattering, file abcde
electrical systems: annual test, load current
annual report 2019
annual sports meet
minutes of the meeting
time table
fee structure
12
12.5
3 4 5
name amount
name of the work | amount | date
roll no | name | marks
22abc014,22abc015,22xyz101
water line 3
sewage line: name, place
section 3 tells the clerk what to do when the form is lost
room 5 in the new block has been given to the first batch
inner area supply network
ab/12/cd
bcdfg
zantpur
irro
page views 12
hits: 1204
found this useful? tell a friend
like this page? share it with your friends
service rules
rules of service and leave
working document on leave rules
document on service conditions
a second document, heat loss
two years after the first document, the road is back
the head asked why the wall had not been painted; the engineer replied that other work came first
total 12 34
the workshop starts at ten and ends at four
readings on the topic are kept in the reading room
the survey covers rainfall, wind and soil, with twelve hours of field work
questions on the course should be sent to the office before 12 may
the department answered 12 questions about the scholarship
forms received after 12 may will be kept aside until june
it was resolved that the report be placed before the council
rules of play
library hours
hostel mess menu
bus timings
placement office
alumni
admissions
faculty
research
आगंतुक संख्या 1204
मुख्य पृष्ठ
मुख्य पृष्ठ खोलें
संपर्क करें
संपर्क करें यहाँ
यह साइट कुकी का उपयोग करती है। स्वीकार करें
सभी छात्र पहचान पत्र प्राप्त करें
कार्यालय सोमवार को बंद रहेगा
छात्रों के लिए कार्यशाला का आयोजन किया गया
विभाग ने छात्रवृत्ति के बारे में प्रश्नों का उत्तर दिया
इस सत्र में दोनों विषयों पर चर्चा होगी
सूची में नाम हैं और इसे जाँचा गया है
छात्र अपना पाठ पढ़ें और प्रश्न लिखें
पुस्तकालय का पृष्ठ
"""

_TOKEN = re.compile(r"<\*>|[^\s\"'.,;:!?()\[\]{}|/\\<>=।]+")
# Function words; prose of five words or more has one of them.
FUNCTION_WORDS = frozenset("the of and to in for is was were a an on by with at be are from that will has have not or as it its this all no must may should who what why after before under between said".split())
_HINDI = re.compile(r"[ऀ-ॿ]")


def stems(message: str) -> list[str]:
    return [w if w == "<*>" else w[:6] for w in _TOKEN.findall(message)]


def shapes(message: str) -> dict[str, float]:
    """Shapes that no single word shows."""
    words = [w for w in _TOKEN.findall(message) if w != "<*>"]
    n = len(words)
    latin = bool(words) and not _HINDI.search(message)
    return {
        "#number": float(n == 1 and words[0].isdigit()),
        "#same": float(2 <= n <= 12 and len(set(words)) <= n / 2 and all(w.isalpha() for w in words)),
        "#one letter": float(any(len(w) >= 3 and len(set(w)) == 1 and w.isalpha() for w in words)),
        "#dotted": float(bool(re.search(r"\b[a-z]+(?:\.[a-z]+)+(?:exception|error)\b", message))),
        "#no function word": float(latin and (n >= 5 and message.endswith(".") or n >= 12 and ". " in message) and not FUNCTION_WORDS & set(words) and all(w.isalpha() for w in words)),
        "#long": float(n > 25),
        "#short": float(n <= 2),
    }


def features(message: str) -> dict[str, float]:
    """Stems and pairs of stems as a unit vector, beside the shapes."""
    s = stems(message)
    out = dict.fromkeys([w for w in s if w != "<*>"] + [f"{a} {b}" for a, b in zip(s, s[1:])] + [f"^{w}" for w in s[:1]], 1.0)
    size = max(1.0, len(out)) ** 0.5
    return {f: v / size for f, v in out.items()} | {k: v / 2 for k, v in shapes(message).items() if v}


def masked(text: str) -> list[str]:
    return [re.sub("[0-9]+", "0", x.strip().lower()) for x in text.strip().split("\n")]


class TextModel:
    """Logistic regression; a message's score is its log odds."""

    def __init__(self, good: list[str], bad: list[str], ridge: float = 0.0002, rounds: int = 800, rate: float = 8.0) -> None:
        rows = [features(m) for m in good + bad]
        names = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}))}
        x = np.zeros((len(rows), len(names) + 1))
        for i, r in enumerate(rows):
            for f, v in r.items():
                x[i, names[f]] = v
        x[:, -1] = 0.5
        y = np.array([0.0] * len(good) + [1.0] * len(bad))
        # Gradient steps on the weights, as sums of the rows.
        inner, part = x @ x.T, np.zeros(len(y))
        for _ in range(rounds):
            part += rate * ((y - 1 / (1 + np.exp(-(inner @ part)))) / len(y) - ridge * part)
        w = x.T @ part
        self.bias = float(w[-1]) / 2
        self.weights = {f: float(w[i]) for f, i in names.items()}

    def score(self, message: str) -> float:
        return self.bias + sum(v * self.weights.get(k, 0.0) for k, v in features(message).items())


@lru_cache(maxsize=1)
def text_model() -> TextModel:
    return TextModel(masked(ORDINARY), masked(RESIDUE))
