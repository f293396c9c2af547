"""Fixed schemas, as DDL text. A fixed schema avoids the extra inference pass over the data
and lets the JSON reader skip every field a query does not ask for."""

from __future__ import annotations

MENTION = "struct<id: bigint, screen_name: string>"
MEDIA = "struct<id: bigint, media_url_https: string, expanded_url: string>"

POST = f"""
    id_str string,
    created_at string,
    timestamp_ms string,
    text string,
    lang string,
    source string,
    in_reply_to_user_id_str string,
    retweet_count bigint,
    favorite_count bigint,
    user struct<
        id_str: string, name: string, screen_name: string, verified: boolean,
        created_at: string, description: string, statuses_count: bigint,
        favourites_count: bigint, followers_count: bigint, friends_count: bigint,
        location: string, time_zone: string, url: string,
        profile_image_url_https: string>,
    entities struct<
        user_mentions: array<{MENTION}>,
        hashtags: array<struct<text: string>>>,
    extended_tweet struct<
        full_text: string,
        entities: struct<media: array<{MEDIA}>>>,
    coordinates struct<coordinates: array<double>>,
    place struct<bounding_box: struct<coordinates: array<array<array<double>>>>>,
    retweeted_status struct<user: struct<id_str: string>>
"""

# The part of a post that account matching needs.
POST_ACCOUNTS = (
    "user struct<id_str: string>, in_reply_to_user_id_str string, "
    "retweeted_status struct<user: struct<id_str: string>>"
)

EVENTS = (
    "name string, normalized_name string, status string, created_at timestamp, "
    "description string, author string"
)
FILE_INDEX = "event string, filename string, timestamp bigint, start_index bigint, end_index bigint"
GEO_INDEX = (
    "event string, geo_hash string, created_at string, username string, user_id_str string, "
    "tweet_id_str string, lang string, source string, in_reply_to_user_id_str string, "
    "text string, image_link string, is_retweet boolean"
)

# The relational tables by name.
TABLES = {
    "events": EVENTS,
    "event_activity": "type string, time timestamp, author string, event_name string",
    "keywords": "event_name string, keyword string",
    "follows": "event_name string, follow string",
    "covid19": "event_name string",
    "tweets": "tweet_id string, tweet string",
    "annotation": "tweet_id string, tag string, event_name string, authuser string",
    "geo_tag_index": GEO_INDEX,
    "event_index": FILE_INDEX,
    "rules": "event string, match_key string, condition string",
}

# Event states, activity kinds, and the topic each match key reads.
ACTIVE, NOT_ACTIVE, FAILED = "ACTIVE", "NOT_ACTIVE", "FAILED"
CREATE_EVENT, START_EVENT, PAUSE_EVENT = "CREATE_EVENT", "START_EVENT", "PAUSE_EVENT"
KEYWORDS, FOLLOWS, COVID19 = "KEYWORDS", "FOLLOWS", "COVID19"
TOPICS = {KEYWORDS: "tweets", FOLLOWS: "tweets-follow", COVID19: "tweets-covid19"}
