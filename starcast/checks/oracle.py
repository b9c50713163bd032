"""The same results in plain SQL over the same tables, for the SQL engine that checks the queries.

The input views and each query are written independently of the DataFrame code: collaborative filtering, for one, is
the textbook form with a left join and a default similarity here, and the subtraction form in the engine.
"""

from __future__ import annotations

VIEWS = {
    "raw_ratings": """
        SELECT o_custkey AS user_id, l_partkey AS business_id, 1 + CAST(l_quantity AS BIGINT) % 5 AS stars,
               o_orderkey AS k, l_linenumber AS ln, l_suppkey AS sk, l_quantity AS q
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ratings": """
        SELECT * FROM raw_ratings WHERE k % 5 <> 0 AND user_id % 29 <> 0 AND business_id % 43 <> 0""",
    "held_out": """
        SELECT * FROM raw_ratings WHERE k % 5 = 0 OR user_id % 29 = 0 OR business_id % 43 = 0""",
    "latest": """
        SELECT user_id, business_id, stars FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, business_id
                                       ORDER BY k DESC, ln DESC, sk DESC, q DESC, stars DESC) AS rn
          FROM ratings) t WHERE rn = 1""",
    "pairs": "SELECT DISTINCT user_id, business_id FROM held_out",
    "truth": """
        SELECT user_id, business_id, max(stars) AS stars FROM held_out
        GROUP BY user_id, business_id""",
    "users": "SELECT * FROM all_users WHERE user_id % 37 <> 0",
    "all_users": """
        SELECT c.c_custkey AS user_id, c.c_name AS name, coalesce(o.n, 0) AS review_count,
               CAST(coalesce(o.y0, 1992) AS VARCHAR(4)) || '-01-01' AS yelping_since,
               CASE WHEN c.c_custkey % 7 = 0 THEN 'None'
                    ELSE CAST(c.c_custkey + 1 AS VARCHAR(20)) || ', ' || CAST(c.c_custkey + 25 AS VARCHAR(20)) || ', '
                         || CAST(c.c_custkey + 2 AS VARCHAR(20)) END AS friends,
               CASE WHEN coalesce(o.n, 0) < 8 THEN 'None' WHEN o.n < 12 THEN '1996' ELSE '1996, 1997' END AS elite,
               coalesce(o.n, 0) * 3 AS useful, CAST(1 + c.c_custkey % 9 * 0.5 AS DOUBLE) AS average_stars
        FROM customer c LEFT JOIN (
          SELECT o_custkey, count(*) AS n, min(year(o_orderdate)) AS y0 FROM orders GROUP BY o_custkey) o
          ON c.c_custkey = o.o_custkey""",
    "businesses": "SELECT * FROM all_businesses WHERE business_id % 41 <> 0",
    "all_businesses": """
        SELECT p_partkey AS business_id, p_name AS name, p_type AS state,
               CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN ''
                    ELSE CAST(10000 + p_partkey * 7 AS VARCHAR(20)) END AS postal_code,
               CAST(1 + p_partkey % 9 * 0.5 AS DOUBLE) AS stars, p_size AS review_count, p_partkey % 2 AS is_open,
               CASE WHEN p_partkey % 17 = 0 THEN NULL
                    ELSE replace(p_name, ' ', ', ') || ', ' || p_type || ', ' || p_brand END AS categories,
               CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 1 END AS has_attributes,
               CASE WHEN p_partkey % 13 <> 0 AND p_size % 6 <> 0 THEN CAST(1 + p_size % 4 AS VARCHAR(4)) END AS price,
               CASE WHEN p_partkey % 13 <> 0 THEN CASE p_size % 5 WHEN 0 THEN 'quiet' WHEN 1 THEN 'average'
                    WHEN 2 THEN 'loud' WHEN 3 THEN 'very_loud' END END AS noise,
               CASE WHEN p_partkey % 13 <> 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'full_bar' END END
                 AS alcohol,
               CASE WHEN p_partkey % 13 <> 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END END
                 AS drive_thru,
               CASE WHEN p_partkey % 13 <> 0 THEN CASE p_size % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END END AS kids,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size % 8 END AS hours_entries
        FROM part""",
    "totals": """
        SELECT business_id, count(*) AS n, CAST(sum(stars) AS BIGINT) AS s FROM ratings GROUP BY business_id""",
    "deviations": """
        SELECT l.user_id, l.business_id, l.stars, t.n * l.stars - t.s AS d
        FROM latest l JOIN totals t ON l.business_id = t.business_id""",
    "candidates": """
        SELECT p.user_id, p.business_id, l.business_id AS other_id, l.stars
        FROM pairs p JOIN latest l ON p.user_id = l.user_id""",
    "item_pairs": """
        SELECT DISTINCT c.business_id AS item_id, c.other_id
        FROM candidates c JOIN totals t ON c.business_id = t.business_id""",
    "overlapping": """
        SELECT x.item_id, x.other_id, count(*) AS common,
               CASE WHEN sum(a.d * a.d) = 0 OR sum(b.d * b.d) = 0 THEN CAST(1 AS DOUBLE)
                    ELSE CAST(sum(a.d * b.d) AS DOUBLE)
                         / (sqrt(CAST(sum(a.d * a.d) AS DOUBLE)) * sqrt(CAST(sum(b.d * b.d) AS DOUBLE))) END AS similarity
        FROM item_pairs x JOIN deviations a ON x.item_id = a.business_id
        JOIN deviations b ON x.other_id = b.business_id AND a.user_id = b.user_id
        GROUP BY x.item_id, x.other_id""",
    "all_similar": """
        SELECT x.item_id, x.other_id, coalesce(s.common, 0) AS common,
               coalesce(s.similarity, CAST(1 AS DOUBLE)) AS similarity
        FROM item_pairs x LEFT JOIN overlapping s ON x.item_id = s.item_id AND x.other_id = s.other_id""",
    "weighted": """
        SELECT c.user_id, c.business_id,
               sum(CASE WHEN a.similarity > 0 THEN c.stars * a.similarity END)
                 / sum(CASE WHEN a.similarity > 0 THEN a.similarity END) AS prediction
        FROM candidates c JOIN all_similar a ON c.business_id = a.item_id AND c.other_id = a.other_id
        GROUP BY c.user_id, c.business_id""",
    "cf": """
        SELECT p.user_id, p.business_id,
               CASE WHEN u.m IS NULL AND b.m IS NULL THEN CAST(2.5 AS DOUBLE)
                    WHEN u.m IS NULL THEN b.m
                    WHEN b.m IS NULL THEN u.m
                    ELSE coalesce(w.prediction, u.m) END AS prediction
        FROM pairs p
        LEFT JOIN (SELECT user_id, avg(stars) AS m FROM latest GROUP BY user_id) u ON p.user_id = u.user_id
        LEFT JOIN (SELECT business_id, avg(stars) AS m FROM latest GROUP BY business_id) b
          ON p.business_id = b.business_id
        LEFT JOIN weighted w ON p.user_id = w.user_id AND p.business_id = w.business_id""",
}
# Which views a view reads.
USES = {
    "ratings": ["raw_ratings"], "latest": ["ratings"], "pairs": ["held_out"], "truth": ["held_out"],
    "held_out": ["raw_ratings"],
    "totals": ["ratings"], "deviations": ["latest", "totals"], "candidates": ["pairs", "latest"],
    "item_pairs": ["candidates", "totals"], "overlapping": ["item_pairs", "deviations"],
    "all_similar": ["item_pairs", "overlapping"], "weighted": ["candidates", "all_similar"],
    "cf": ["pairs", "latest", "weighted"],
}


def with_views(names: str, body: str) -> str:
    """``body`` behind the definitions of the views it names and of all they read."""
    needed: list[str] = []

    def add(name: str) -> None:
        for used in USES.get(name, []):
            add(used)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        add(name)
    definitions = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {definitions} {body}" if needed else body

VIEWS |= {
    "used_businesses": """
        SELECT * FROM businesses
        WHERE business_id IN (SELECT business_id FROM ratings UNION SELECT business_id FROM pairs)""",
    "listed": """
        SELECT business_id, unnest(string_split(categories, ', ')) AS category FROM used_businesses
        WHERE categories IS NOT NULL""",
    "counts": "SELECT category, count(*) AS count FROM listed GROUP BY category",
    "labels": "SELECT category, count FROM counts ORDER BY count DESC, category LIMIT 30",
    "flags": """
        SELECT b.business_id, min(b.categories) AS categories,
               string_agg(CASE WHEN list_contains(string_split(b.categories, ', '), l.category) THEN '1' ELSE '0' END,
                          '' ORDER BY l.category) AS flags
        FROM used_businesses b JOIN labels l ON true GROUP BY b.business_id""",
    "edges": """
        SELECT DISTINCT user_id, CAST(friend AS BIGINT) AS friend_id
        FROM (SELECT user_id, unnest(string_split(friends, ', ')) AS friend FROM users WHERE friends <> 'None') f""",
    "states": """
        SELECT state, row_number() OVER (ORDER BY state) - 1 AS state_code
        FROM (SELECT DISTINCT state FROM used_businesses) s""",
    "mean": "SELECT avg(stars) AS mean_stars FROM ratings",
    "cold_scored": """
        SELECT p.user_id, p.business_id,
               CASE WHEN u.user_id IS NOT NULL THEN u.average_stars WHEN b.business_id IS NOT NULL THEN b.stars
                    ELSE (SELECT mean_stars FROM mean) END AS prediction
        FROM pairs p LEFT JOIN users u ON p.user_id = u.user_id LEFT JOIN businesses b ON p.business_id = b.business_id""",
    "joined": """
        SELECT t.user_id, t.business_id, t.stars, c.prediction, c.prediction - t.stars AS diff
        FROM truth t JOIN cold_scored c ON t.user_id = c.user_id AND t.business_id = c.business_id""",
    "friend_means": """
        SELECT p.user_id, p.business_id, avg(l.stars) AS friend_mean
        FROM (SELECT user_id, business_id FROM ratings UNION SELECT user_id, business_id FROM pairs) p
        JOIN edges e ON p.user_id = e.user_id
        JOIN latest l ON e.friend_id = l.user_id AND p.business_id = l.business_id
        GROUP BY p.user_id, p.business_id""",
    "user_table": """
        SELECT user_id, CAST(review_count AS DOUBLE) AS u_review_count,
               CAST(substr(yelping_since, 1, 4) AS DOUBLE) AS u_yelping_since,
               CASE WHEN elite = 'None' THEN CAST(0 AS DOUBLE)
                    ELSE CAST(len(string_split(elite, ', ')) AS DOUBLE) END AS u_elite,
               CAST(useful AS DOUBLE) AS u_useful, average_stars AS u_average_stars,
               CASE WHEN friends = 'None' THEN CAST(0 AS DOUBLE)
                    ELSE CAST(len(string_split(friends, ', ')) AS DOUBLE) END AS u_friends_cnt
        FROM users""",
    "attribute_table": """
        SELECT business_id, CAST(price AS INTEGER) AS price,
               CASE noise WHEN 'average' THEN 0 WHEN 'loud' THEN 1 WHEN 'quiet' THEN 2 WHEN 'very_loud' THEN 3 END AS noise,
               CASE alcohol WHEN 'none' THEN 0 WHEN 'full_bar' THEN 1 END AS alcohol,
               CASE drive_thru WHEN 'True' THEN 1 WHEN 'False' THEN 0 END AS drive_thru,
               CASE kids WHEN 'True' THEN 1 WHEN 'False' THEN 0 END AS kids,
               CASE WHEN has_attributes = 1 THEN coalesce(CAST(price AS INTEGER), 2) END AS price2,
               CASE WHEN has_attributes = 1 THEN CASE coalesce(noise, 'average') WHEN 'average' THEN 0 WHEN 'loud' THEN 1
                    WHEN 'quiet' THEN 2 ELSE 3 END END AS noise0
        FROM businesses""",
    "business_table": """
        SELECT b.business_id, CASE WHEN b.postal_code <> '' THEN CAST(unicode(b.postal_code) AS DOUBLE) END AS b_postal_code,
               b.stars AS b_stars, CAST(b.review_count AS DOUBLE) AS b_review_count,
               CAST(b.is_open AS DOUBLE) AS b_is_open, CAST(nullif(b.hours_entries, 0) AS DOUBLE) AS b_hours,
               CASE WHEN b.categories IS NOT NULL THEN f.flags END AS flags,
               CAST(a.price AS DOUBLE) AS b_price, CAST(a.noise AS DOUBLE) AS b_noise,
               CAST(a.alcohol AS DOUBLE) AS b_alcohol, CAST(a.drive_thru AS DOUBLE) AS b_drive_thru,
               CAST(a.kids AS DOUBLE) AS b_kids
        FROM used_businesses b JOIN flags f ON b.business_id = f.business_id
        JOIN attribute_table a ON b.business_id = a.business_id""",
    "train_features": """
        SELECT r.user_id, r.business_id, CAST(r.stars AS DOUBLE) AS stars, u.* EXCLUDE (user_id),
               b.* EXCLUDE (business_id), m.friend_mean
        FROM ratings r JOIN user_table u ON r.user_id = u.user_id JOIN business_table b ON r.business_id = b.business_id
        LEFT JOIN friend_means m ON r.user_id = m.user_id AND r.business_id = m.business_id""",
    "linear_businesses": """
        SELECT b.business_id, b.stars, b.review_count, a.price2 AS price, s.state_code AS state, a.noise0 AS noise, f.flags
        FROM used_businesses b JOIN flags f ON b.business_id = f.business_id
        JOIN attribute_table a ON b.business_id = a.business_id JOIN states s ON b.state = s.state""",
    "single": """
        SELECT r.user_id, r.business_id, CAST(r.stars AS DOUBLE) AS y, u.average_stars AS x
        FROM ratings r JOIN users u ON r.user_id = u.user_id""",
    "moments": """
        SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS sxy, var_pop(x) AS sxx FROM single""",
}
VIEWS |= {
    "all_user_table": VIEWS["user_table"].replace("FROM users", "FROM all_users"),
    "all_attribute_table": VIEWS["attribute_table"].replace("FROM businesses", "FROM all_businesses"),
}
USES |= {
    "users": ["all_users"], "businesses": ["all_businesses"], "all_user_table": ["all_users"],
    "all_attribute_table": ["all_businesses"], "used_businesses": ["businesses", "ratings", "pairs"], "listed": ["used_businesses"], "counts": ["listed"],
    "labels": ["counts"], "flags": ["used_businesses", "labels"], "edges": ["users"], "states": ["used_businesses"],
    "mean": ["ratings"], "cold_scored": ["pairs", "users", "businesses", "mean"], "joined": ["truth", "cold_scored"],
    "friend_means": ["ratings", "pairs", "edges", "latest"], "user_table": ["users"],
    "attribute_table": ["businesses"], "business_table": ["used_businesses", "flags", "attribute_table"],
    "train_features": ["ratings", "user_table", "business_table", "friend_means"],
    "linear_businesses": ["used_businesses", "flags", "attribute_table", "states"],
    "single": ["ratings", "users"], "moments": ["single"],
}


def _linear_features(pairs: str) -> str:
    zeros = "repeat('0', 30)"
    return f"""
        SELECT p.user_id, p.business_id,
               CAST(CASE WHEN u.user_id IS NULL THEN 0 ELSE u.review_count END AS DOUBLE) AS u_review_count,
               CAST(CASE WHEN u.user_id IS NULL THEN 2.5 ELSE u.average_stars END AS DOUBLE) AS u_average_stars,
               CAST(CASE WHEN u.user_id IS NULL THEN 0 ELSE u.useful END AS DOUBLE) AS u_useful,
               CAST(CASE WHEN b.business_id IS NULL THEN 2.5 ELSE b.stars END AS DOUBLE) AS b_stars,
               CAST(CASE WHEN b.business_id IS NULL THEN 0 ELSE b.review_count END AS DOUBLE) AS b_review_count,
               CAST(b.price AS DOUBLE) AS b_price, CAST(b.state AS DOUBLE) AS b_state, CAST(b.noise AS DOUBLE) AS b_noise,
               CASE WHEN b.business_id IS NULL THEN {zeros} ELSE b.flags END AS flags
        FROM {pairs} p LEFT JOIN users u ON p.user_id = u.user_id
        LEFT JOIN linear_businesses b ON p.business_id = b.business_id"""


VIEWS |= {"linear_pairs": _linear_features("pairs"), "linear_train": _linear_features("ratings")}
USES |= {
    "linear_pairs": ["pairs", "users", "linear_businesses"],
    "linear_train": ["ratings", "users", "linear_businesses"],
}

_PREDICTIONS = with_views(
    "cold_scored",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(business_id AS VARCHAR) AS business_id,
              round(prediction, 6) AS prediction FROM cold_scored""",
)


def _histogram(closed: str) -> str:
    rows = []
    for low in range(4):
        if closed == "left":
            inside = f"abs(diff) >= {low} AND abs(diff) < {low + 1}"
        else:
            inside = f"abs(diff) >{'=' if low == 0 else ''} {low} AND abs(diff) <= {low + 1}"
        rows.append(f"SELECT '{low}-{low + 1}' AS bin, count(*) AS count FROM joined WHERE {inside}")
    return with_views("joined", " UNION ALL ".join(rows))


def _single(slope: str) -> str:
    return with_views(
        "single moments",
        f"""SELECT s.user_id, s.business_id, round(m.my + ({slope}) * (s.x - m.mx), 5) AS prediction
            FROM single s, moments m""",
    )


# A booster on one feature with few values, whose leaves may hold a single row.
_VALUE_MEANS = with_views(
    "single",
    """SELECT s.user_id, s.business_id, round(m.mean, 5) AS prediction
       FROM single s JOIN (SELECT x, avg(y) AS mean FROM single GROUP BY x) m ON s.x = m.x""",
)
# The same in a whole job: pairs with both entity rows, and the cold-start rule for the others.
_VALUE_MEANS_AND_COLD = with_views(
    "train_features users businesses cold_scored",
    """SELECT c.user_id, c.business_id,
              round(CASE WHEN u.user_id IS NOT NULL AND b.business_id IS NOT NULL
                         THEN least(5, greatest(1, m.mean)) ELSE c.prediction END, 5) AS prediction
       FROM cold_scored c LEFT JOIN users u ON c.user_id = u.user_id
       LEFT JOIN businesses b ON c.business_id = b.business_id
       LEFT JOIN (SELECT u_average_stars AS x, avg(stars) AS mean FROM train_features GROUP BY u_average_stars) m
         ON u.average_stars = m.x""",
)

_SOFT = "sign(m.sxy) * greatest(abs(m.sxy) - {}, 0)"

ORACLE = {
    "read_ratings": with_views(
        "ratings",
        """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(business_id AS VARCHAR) AS business_id,
                  CAST(stars AS DOUBLE) AS stars FROM ratings""",
    ),
    "read_pairs": with_views(
        "pairs",
        "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(business_id AS VARCHAR) AS business_id FROM pairs",
    ),
    "read_truth": with_views(
        "truth",
        """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(business_id AS VARCHAR) AS business_id,
                  CAST(stars AS DOUBLE) AS stars FROM truth""",
    ),
    "read_users": with_views(
        "all_users",
        """SELECT CAST(user_id AS VARCHAR) AS user_id, name, CAST(review_count AS BIGINT) AS review_count, yelping_since,
                  friends, CAST(useful AS BIGINT) AS useful, elite, average_stars FROM all_users""",
    ),
    "read_businesses": with_views(
        "all_businesses",
        """SELECT CAST(business_id AS VARCHAR) AS business_id, state, postal_code, stars,
                  CAST(review_count AS BIGINT) AS review_count, CAST(is_open AS BIGINT) AS is_open, categories, noise,
                  CAST(hours_entries AS BIGINT) AS hours_entries FROM all_businesses""",
    ),
    "write_predictions": _PREDICTIONS,
    "read_predictions": _PREDICTIONS,
    "rekey_ratings": with_views("ratings", "SELECT user_id, business_id, stars FROM ratings"),
    "user_feature_columns": with_views(
        "all_users", "SELECT user_id, review_count, yelping_since, elite, useful, average_stars FROM all_users"
    ),
    "business_feature_columns": with_views(
        "all_businesses",
        """SELECT business_id, postal_code, stars, review_count, is_open, CAST(hours_entries AS BIGINT) AS hours
           FROM all_businesses""",
    ),
    "linear_user_view": with_views("all_users", "SELECT user_id, review_count, average_stars, useful FROM all_users"),
    "linear_business_view": with_views(
        "linear_businesses",
        """SELECT business_id, stars, review_count, CAST(price AS BIGINT) AS price, CAST(state AS BIGINT) AS state,
                  CAST(noise AS BIGINT) AS noise, flags FROM linear_businesses""",
    ),
    "positive_similarities": with_views(
        "all_similar",
        "SELECT item_id, other_id, round(similarity, 6) AS similarity FROM all_similar WHERE similarity > 0",
    ),
    "error_signs": with_views(
        "joined",
        """SELECT user_id, business_id, CASE WHEN diff > 0 THEN 'over' ELSE 'under' END AS side, round(diff, 6) AS diff
           FROM joined WHERE diff <> 0""",
    ),
    "cold_case": with_views(
        "pairs latest",
        """SELECT p.user_id, p.business_id,
                  CASE WHEN u.user_id IS NULL AND b.business_id IS NULL THEN 'both' WHEN u.user_id IS NULL THEN 'user'
                       WHEN b.business_id IS NULL THEN 'business' ELSE 'warm' END AS cold_side
           FROM pairs p LEFT JOIN (SELECT DISTINCT user_id FROM latest) u ON p.user_id = u.user_id
           LEFT JOIN (SELECT DISTINCT business_id FROM latest) b ON p.business_id = b.business_id""",
    ),
    "prune_users": with_views(
        "users ratings pairs",
        """SELECT user_id, name FROM users
           WHERE user_id IN (SELECT user_id FROM ratings) OR user_id IN (SELECT user_id FROM pairs)""",
    ),
    "prune_businesses": with_views("used_businesses", "SELECT business_id, name FROM used_businesses"),
    "unseen_users": with_views(
        "pairs users", "SELECT DISTINCT user_id FROM pairs WHERE user_id NOT IN (SELECT user_id FROM users)"
    ),
    "unseen_businesses": with_views(
        "pairs businesses",
        "SELECT DISTINCT business_id FROM pairs WHERE business_id NOT IN (SELECT business_id FROM businesses)",
    ),
    "split_cold": with_views(
        "pairs users businesses",
        """SELECT user_id, business_id,
                  CASE WHEN user_id IN (SELECT user_id FROM users)
                        AND business_id IN (SELECT business_id FROM businesses) THEN 'known' ELSE 'cold' END AS part
           FROM pairs""",
    ),
    "attach_user_features": with_views(
        "pairs user_table",
        """SELECT p.user_id, p.business_id, u.* EXCLUDE (user_id)
           FROM pairs p JOIN user_table u ON p.user_id = u.user_id""",
    ),
    "attach_business_features": with_views(
        "pairs business_table",
        """SELECT p.user_id, p.business_id, b_postal_code, b_stars, b_review_count, b_is_open, b_hours, flags
           FROM pairs p JOIN business_table b ON p.business_id = b.business_id""",
    ),
    "attach_with_defaults": with_views("linear_pairs", "SELECT * FROM linear_pairs"),
    "mutual_friends": with_views(
        "pairs edges latest",
        """SELECT p.user_id, p.business_id, e.friend_id, l.stars FROM pairs p JOIN edges e ON p.user_id = e.user_id
           JOIN latest l ON e.friend_id = l.user_id AND p.business_id = l.business_id""",
    ),
    "cf_candidates": with_views("candidates", "SELECT user_id, business_id, other_id, stars FROM candidates"),
    "corated": with_views(
        "item_pairs latest",
        """, raters AS (SELECT business_id, count(*) AS n FROM latest GROUP BY business_id),
           oriented AS (
             SELECT DISTINCT
               CASE WHEN a.n < b.n OR (a.n = b.n AND x.item_id < x.other_id) THEN x.item_id ELSE x.other_id END AS small_id,
               CASE WHEN a.n < b.n OR (a.n = b.n AND x.item_id < x.other_id) THEN x.other_id ELSE x.item_id END AS large_id
             FROM item_pairs x JOIN raters a ON x.item_id = a.business_id JOIN raters b ON x.other_id = b.business_id)
           SELECT o.small_id, o.large_id, a.user_id, CAST(a.stars AS DOUBLE) AS small_stars,
                  CAST(b.stars AS DOUBLE) AS large_stars
           FROM oriented o JOIN latest a ON o.small_id = a.business_id
           JOIN latest b ON o.large_id = b.business_id AND a.user_id = b.user_id""",
    ),
    "average_lookup": with_views(
        "item_pairs ratings",
        """, means AS (SELECT business_id, avg(stars) AS m FROM ratings GROUP BY business_id)
           SELECT x.item_id, x.other_id, round(a.m, 6) AS item_mean, round(b.m, 6) AS other_mean
           FROM item_pairs x JOIN means a ON x.item_id = a.business_id JOIN means b ON x.other_id = b.business_id""",
    ),
    "join_truth": with_views(
        "joined", "SELECT user_id, business_id, stars, round(prediction, 6) AS prediction FROM joined"
    ),
    "distinct_ids": with_views("ratings", "SELECT DISTINCT user_id FROM ratings"),
    "business_mean": with_views(
        "ratings", "SELECT business_id, round(avg(stars), 6) AS mean_stars FROM ratings GROUP BY business_id"
    ),
    "cold_user_mean": with_views(
        "latest", "SELECT business_id, round(avg(stars), 6) AS mean_stars FROM latest GROUP BY business_id"
    ),
    "cold_business_mean": with_views(
        "latest", "SELECT user_id, round(avg(stars), 6) AS mean_stars FROM latest GROUP BY user_id"
    ),
    "global_mean": with_views("mean", "SELECT round(mean_stars, 6) AS mean_stars FROM mean"),
    "ratings_by_business": with_views("ratings", "SELECT business_id, user_id, stars FROM ratings"),
    "raters_by_business": with_views("ratings", "SELECT DISTINCT business_id, user_id FROM ratings"),
    "latest_rating": with_views("latest", "SELECT * FROM latest"),
    "category_counts": with_views("counts", "SELECT * FROM counts"),
    "mutual_friend_means": with_views(
        "pairs friend_means",
        """SELECT p.user_id, p.business_id, round(m.friend_mean, 6) AS friend_mean
           FROM pairs p JOIN friend_means m ON p.user_id = m.user_id AND p.business_id = m.business_id""",
    ),
    "item_similarity": with_views(
        "all_similar", "SELECT item_id, other_id, common, round(similarity, 6) AS similarity FROM all_similar"
    ),
    "weighted_prediction": with_views(
        "weighted", "SELECT user_id, business_id, round(prediction, 6) AS prediction FROM weighted"
    ),
    "signed_error_totals": with_views(
        "joined",
        """SELECT round(sum(CASE WHEN diff > 0 THEN diff ELSE 0 END), 6) AS over_sum,
                  count(CASE WHEN diff > 0 THEN 1 END) AS over_count,
                  round(sum(CASE WHEN diff < 0 THEN diff ELSE 0 END), 6) AS under_sum,
                  count(CASE WHEN diff < 0 THEN 1 END) AS under_count FROM joined""",
    ),
    "rmse": with_views("joined", "SELECT round(sqrt(avg(diff * diff)), 6) AS rmse FROM joined"),
    "error_histogram": _histogram("right"),
    "error_histogram_left": _histogram("left"),
    "column_means": with_views(
        "train_features",
        "SELECT "
        + ", ".join(
            f"round(avg({c}), 6) AS {c}"
            for c in ["u_yelping_since", "u_average_stars", "b_stars", "b_hours", "friend_mean"]
        )
        + " FROM train_features",
    ),
    "top_categories": with_views("labels", "SELECT category, count FROM labels"),
    "possible_users": with_views(
        "ratings pairs", "SELECT user_id FROM ratings UNION SELECT user_id FROM pairs"
    ),
    "id_difference": with_views("pairs users", "SELECT user_id FROM pairs EXCEPT SELECT user_id FROM users"),
    "friends_and_raters": with_views(
        "edges ratings", "SELECT friend_id AS user_id FROM edges INTERSECT SELECT user_id FROM ratings"
    ),
    "append_known_and_cold": with_views(
        "pairs users businesses cold_scored",
        """SELECT c.user_id, c.business_id,
                  round(CASE WHEN u.user_id IS NULL OR b.business_id IS NULL THEN c.prediction
                             ELSE greatest(least((u.average_stars + b.stars) / 2, 5), 1) END, 6) AS prediction
           FROM cold_scored c LEFT JOIN users u ON c.user_id = u.user_id
           LEFT JOIN businesses b ON c.business_id = b.business_id""",
    ),
    "split_categories": with_views(
        "all_businesses",
        """SELECT business_id, coalesce(array_to_string(list_sort(string_split(categories, ', ')), ', '), '') AS labels,
                  CAST(coalesce(len(string_split(categories, ', ')), 0) AS INTEGER) AS number FROM all_businesses""",
    ),
    "keep_top": with_views(
        "used_businesses listed labels",
        """SELECT b.business_id, coalesce(k.labels, '') AS labels FROM used_businesses b LEFT JOIN (
             SELECT business_id, string_agg(category, ', ' ORDER BY category) AS labels
             FROM (SELECT DISTINCT business_id, category FROM listed WHERE category IN (SELECT category FROM labels)) d
             GROUP BY business_id) k ON b.business_id = k.business_id""",
    ),
    "category_flags": with_views(
        "flags", "SELECT business_id, CASE WHEN categories IS NOT NULL THEN flags END AS flags FROM flags"
    ),
    "category_flags_zero": with_views("flags", "SELECT business_id, flags FROM flags"),
    "friend_list": with_views(
        "all_users",
        """SELECT user_id, CASE WHEN friends = 'None' THEN ''
                  ELSE array_to_string(list_sort(list_distinct(string_split(friends, ', '))), ', ') END AS friends
           FROM all_users""",
    ),
    "friend_count": with_views(
        "all_user_table", "SELECT user_id, CAST(u_friends_cnt AS INTEGER) AS friends_cnt FROM all_user_table"
    ),
    "elite_count": with_views("all_user_table", "SELECT user_id, CAST(u_elite AS INTEGER) AS elite FROM all_user_table"),
    "start_year": with_views(
        "all_user_table", "SELECT user_id, CAST(u_yelping_since AS INTEGER) AS start_year FROM all_user_table"
    ),
    "postal_code_point": with_views(
        "all_businesses",
        """SELECT business_id, CASE WHEN postal_code <> '' THEN CAST(unicode(postal_code) AS INTEGER) END AS postal_code
           FROM all_businesses""",
    ),
    "days_open": with_views(
        "all_businesses", "SELECT business_id, CAST(nullif(hours_entries, 0) AS INTEGER) AS hours FROM all_businesses"
    ),
    "price_range": with_views("all_attribute_table", "SELECT business_id, price AS value FROM all_attribute_table"),
    "price_range_default2": with_views("all_attribute_table", "SELECT business_id, price2 AS value FROM all_attribute_table"),
    "noise_code": with_views("all_attribute_table", "SELECT business_id, noise AS value FROM all_attribute_table"),
    "noise_code_default_average": with_views(
        "all_attribute_table", "SELECT business_id, noise0 AS value FROM all_attribute_table"
    ),
    "alcohol_flag": with_views("all_attribute_table", "SELECT business_id, alcohol AS value FROM all_attribute_table"),
    "drive_thru_flag": with_views("all_attribute_table", "SELECT business_id, drive_thru AS value FROM all_attribute_table"),
    "kids_flag": with_views("all_attribute_table", "SELECT business_id, kids AS value FROM all_attribute_table"),
    "map_lookup": with_views(
        "all_businesses",
        """SELECT business_id, CASE WHEN has_attributes = 1 THEN coalesce(alcohol, 'unknown') END AS value
           FROM all_businesses""",
    ),
    "attribute_columns": with_views(
        "all_attribute_table", "SELECT business_id, price, noise, alcohol, drive_thru, kids FROM all_attribute_table"
    ),
    "state_code": with_views(
        "used_businesses states",
        """SELECT b.business_id, b.state, CAST(s.state_code AS BIGINT) AS state_code
           FROM used_businesses b JOIN states s ON b.state = s.state""",
    ),
    "clipped_error": with_views(
        "joined",
        """SELECT user_id, business_id, round(greatest(least((prediction - 3) * 2 + 3, 5), 1), 6) AS clipped
           FROM joined""",
    ),
    "ensemble_means": with_views(
        "joined", "SELECT user_id, business_id, round((prediction + 3 + stars) / 3, 6) AS mean FROM joined"
    ),
    "prediction_errors": with_views(
        "joined",
        """SELECT user_id, business_id, round(diff, 6) AS diff, round(diff * diff, 6) AS square,
                  round(abs(diff), 6) AS size FROM joined""",
    ),
    "fill_mean": with_views(
        "train_features",
        """SELECT user_id, business_id,
                  round(coalesce(u_yelping_since, (SELECT avg(u_yelping_since) FROM train_features)), 6) AS u_yelping_since,
                  round(coalesce(u_average_stars, (SELECT avg(u_average_stars) FROM train_features)), 6) AS u_average_stars,
                  round(coalesce(b_stars, (SELECT avg(b_stars) FROM train_features)), 6) AS b_stars,
                  round(coalesce(friend_mean, (SELECT avg(u_average_stars) FROM train_features)), 6) AS friend_mean,
                  coalesce(b_price, 0) AS b_price, coalesce(b_hours, 0) AS b_hours
           FROM train_features""",
    ),
    "assemble_pair_features": with_views(
        "train_features", "SELECT * REPLACE (round(friend_mean, 6) AS friend_mean) FROM train_features"
    ),
    "mean_imputed": with_views(
        "linear_train",
        """SELECT user_id, business_id,
                  round(coalesce(b_price, (SELECT avg(b_price) FROM linear_train)), 6) AS b_price,
                  round(coalesce(b_state, (SELECT avg(b_state) FROM linear_train)), 6) AS b_state,
                  round(coalesce(b_noise, (SELECT avg(b_noise) FROM linear_train)), 6) AS b_noise
           FROM linear_train""",
    ),
    "missing_flags": with_views(
        "train_features",
        """SELECT user_id, business_id, coalesce(b_price, 0) AS b_price, coalesce(b_hours, 0) AS b_hours,
                  round(coalesce(friend_mean, 0), 6) AS friend_mean,
                  CAST(b_price IS NULL AS DOUBLE) AS b_price_missing, CAST(b_hours IS NULL AS DOUBLE) AS b_hours_missing,
                  CAST(friend_mean IS NULL AS DOUBLE) AS friend_mean_missing
           FROM train_features""",
    ),
    "default_rows": with_views(
        "linear_pairs users businesses",
        """SELECT * EXCLUDE (flags) FROM linear_pairs
           WHERE user_id NOT IN (SELECT user_id FROM users)
              OR business_id NOT IN (SELECT business_id FROM businesses)""",
    ),
    "linear_single": _single("m.sxy / m.sxx"),
    "ridge_single": _single("m.sxy * m.n / (m.sxx * m.n + 50000)"),
    "lasso_single": _single(_SOFT.format("0.001") + " / m.sxx"),
    "elastic_net_single": _single(_SOFT.format("0.002 * 0.4") + " / (m.sxx + 0.002 * 0.6)"),
    "robust_scaled_single": with_views(
        "single moments",
        """, r AS (SELECT quantile_disc(x, 0.75) - quantile_disc(x, 0.25) AS width FROM single)
           SELECT s.user_id, s.business_id,
                  round(m.my + m.sxy * m.n / (m.sxx * m.n + 50000 * r.width * r.width) * (s.x - m.mx), 5) AS prediction
           FROM single s, moments m, r""",
    ),
    "save_and_load_single": _single("m.sxy / m.sxx"),
    "gbt_a_single": _VALUE_MEANS,
    "gbt_b_single": _VALUE_MEANS,
    "stacked_single": _VALUE_MEANS,
    "hybrid_recommender_single": _VALUE_MEANS_AND_COLD,
    "stacked_recommender_single": _VALUE_MEANS_AND_COLD,
    "linear_recommender_single": with_views(
        "ratings pairs users",
        """, t AS (SELECT CAST(r.stars AS DOUBLE) AS y, coalesce(u.average_stars, 2.5) AS x
                   FROM ratings r LEFT JOIN users u ON r.user_id = u.user_id),
             m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / var_pop(x) AS slope FROM t)
           SELECT p.user_id, p.business_id,
                  round(m.my + m.slope * (coalesce(u.average_stars, 2.5) - m.mx), 5) AS prediction
           FROM pairs p LEFT JOIN users u ON p.user_id = u.user_id, m""",
    ),
    "item_cf_predictions": with_views(
        "cf", "SELECT user_id, business_id, round(prediction, 6) AS prediction FROM cf"
    ),
    "cold_start": with_views(
        "cold_scored", "SELECT user_id, business_id, round(prediction, 6) AS prediction FROM cold_scored"
    ),
    "evaluate_item_cf": with_views(
        "truth cf",
        """, e AS (SELECT round(c.prediction, 9) - t.stars AS diff FROM truth t
                   JOIN cf c ON t.user_id = c.user_id AND t.business_id = c.business_id)
           SELECT count(*) AS pairs, round(sqrt(avg(diff * diff)), 4) AS rmse,
                  round(sum(CASE WHEN diff > 0 THEN diff ELSE 0 END), 4) AS over_sum,
                  count(CASE WHEN diff > 0 THEN 1 END) AS over_count,
                  round(sum(CASE WHEN diff < 0 THEN diff ELSE 0 END), 4) AS under_sum,
                  count(CASE WHEN diff < 0 THEN 1 END) AS under_count,
                  count(CASE WHEN abs(diff) <= 1 THEN 1 END) AS errors_0_1,
                  count(CASE WHEN abs(diff) > 1 AND abs(diff) <= 2 THEN 1 END) AS errors_1_2,
                  count(CASE WHEN abs(diff) > 2 AND abs(diff) <= 3 THEN 1 END) AS errors_2_3,
                  count(CASE WHEN abs(diff) > 3 AND abs(diff) <= 4 THEN 1 END) AS errors_3_4
           FROM e""",
    ),
}

# The grids of the linear searches as rows: kind, alpha, share of the absolute penalty.
_POINTS = ", ".join(
    [f"('ridge', {a}::DOUBLE, 0::DOUBLE)" for a in ("0.0001", "0.001", "0.01", "0.1", "1", "10", "100")]
    + [f"('lasso', {a}::DOUBLE, 1::DOUBLE)" for a in ("0.0001", "0.0003", "0.0005", "0.0007")]
    + [
        f"('elastic_net', {a}::DOUBLE, {l1}::DOUBLE)"
        for a in ("0.0001", "0.0003", "0.0005", "0.0007") for l1 in ("0.3", "0.4", "0.5")
    ]
)
# Each fold's fit by the closed form for one column, and its error on the rows left out.
ORACLE["grid_search_linear_single"] = with_views(
    "single",
    f""", points(kind, alpha, l1) AS (VALUES {_POINTS}), folds AS (SELECT DISTINCT user_id % 5 AS fold FROM single),
         fits AS (
           SELECT f.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS sxy, var_pop(x) AS sxx
           FROM folds f JOIN single s ON s.user_id % 5 <> f.fold GROUP BY f.fold),
         lines AS (
           SELECT p.*, m.fold, m.mx, m.my,
                  CASE WHEN kind = 'ridge' THEN m.sxy * m.n / (m.sxx * m.n + alpha)
                       ELSE sign(m.sxy) * greatest(abs(m.sxy) - alpha * l1, 0) / (m.sxx + alpha * (1 - l1)) END AS slope
           FROM points p, fits m),
         errors AS (
           SELECT kind, alpha, l1, l.fold, sqrt(avg((s.y - l.my - slope * (s.x - l.mx)) ** 2)) AS error
           FROM lines l JOIN single s ON s.user_id % 5 = l.fold GROUP BY kind, alpha, l1, l.fold)
         SELECT kind, alpha, l1 AS l1_ratio, round(-avg(error), 8) AS score FROM errors GROUP BY kind, alpha, l1""",
)
ORACLE["saved_recommender_single"] = _VALUE_MEANS_AND_COLD
# Leaves of one row a value: the first tree is the mean of each value, and the later ones add nothing.
ORACLE["search_boosters_single"] = with_views(
    "single",
    """, means AS (
           SELECT f.fold, x, avg(y) AS mean FROM (SELECT DISTINCT user_id % 5 AS fold FROM single) f
           JOIN single s ON s.user_id % 5 <> f.fold GROUP BY f.fold, x),
         errors AS (
           SELECT m.fold, sqrt(avg((s.y - m.mean) ** 2)) AS error
           FROM single s JOIN means m ON s.user_id % 5 = m.fold AND s.x = m.x GROUP BY m.fold)
         SELECT trees, step, round(-avg(error), 5) AS score
         FROM errors, (VALUES (1::BIGINT), (2), (3)) a(trees), (VALUES (0.05::DOUBLE), (0.1)) b(step) GROUP BY trees, step""",
)
ORACLE["quarantined_ratings"] = with_views(
    "ratings",
    """SELECT reason, count(*) AS rows FROM (
         SELECT CASE WHEN q % 11 = 0 THEN 'malformed' WHEN q % 13 = 0 THEN 'no user_id' WHEN q % 17 = 0 THEN 'no business_id'
                     WHEN q % 19 = 0 THEN 'no stars' ELSE 'good' END AS reason FROM ratings) r GROUP BY reason""",
)
# One tree whose leaves are the values of the column: the free intercept, and residuals over rows plus penalty in each leaf.
ORACLE["leaf_penalty_single"] = with_views(
    "single",
    """, leaves AS (SELECT x, count(*) AS n, avg(y) AS mean FROM single GROUP BY x),
         penalties(l2) AS (VALUES (0.1::DOUBLE), (1), (3), (10)),
         shifts AS (SELECT l2, sum(n / (n + l2) * mean) / sum(n / (n + l2)) AS shift FROM leaves, penalties GROUP BY l2)
         SELECT l2, x AS average_stars, round(shift + n * (mean - shift) / (n + l2), 5) AS prediction
         FROM leaves, shifts""",
)
# From scratch, on the ratings that are left at the end.
ORACLE["similarity_upkeep"] = with_views(
    "ratings item_pairs",
    """, left_rows AS (SELECT * FROM ratings WHERE k % 7 <> 0),
         last AS (
           SELECT user_id, business_id, stars FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id, business_id
                                          ORDER BY k DESC, ln DESC, sk DESC, q DESC, stars DESC) AS rn
             FROM left_rows) t WHERE rn = 1),
         sizes AS (SELECT business_id, count(*) AS n, CAST(sum(stars) AS BIGINT) AS s FROM left_rows GROUP BY business_id),
         moved AS (
           SELECT l.user_id, l.business_id, t.n * l.stars - t.s AS d FROM last l JOIN sizes t ON l.business_id = t.business_id),
         both_rated AS (
           SELECT DISTINCT least(item_id, other_id) AS small_id, greatest(item_id, other_id) AS large_id
           FROM item_pairs WHERE item_id <> other_id),
         shared AS (
           SELECT x.small_id, x.large_id, count(*) AS common,
                  CASE WHEN sum(a.d * a.d) = 0 OR sum(b.d * b.d) = 0 THEN CAST(1 AS DOUBLE)
                       ELSE CAST(sum(a.d * b.d) AS DOUBLE)
                            / (sqrt(CAST(sum(a.d * a.d) AS DOUBLE)) * sqrt(CAST(sum(b.d * b.d) AS DOUBLE))) END AS similarity
           FROM both_rated x JOIN moved a ON x.small_id = a.business_id
           JOIN moved b ON x.large_id = b.business_id AND a.user_id = b.user_id GROUP BY x.small_id, x.large_id)
         SELECT x.small_id, x.large_id, coalesce(s.common, 0) AS common, round(coalesce(s.similarity, 1), 6) AS similarity
         FROM both_rated x JOIN sizes a ON x.small_id = a.business_id JOIN sizes b ON x.large_id = b.business_id
         LEFT JOIN shared s ON x.small_id = s.small_id AND x.large_id = s.large_id""",
)
# Closed forms on the column over its interquartile range, for each fold left out.
ORACLE["out_of_fold_single"] = with_views(
    "single",
    """, folds AS (SELECT DISTINCT user_id % 5 AS fold FROM single),
         m AS (
           SELECT f.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS sxy, var_pop(x) AS sxx,
                  quantile_disc(x, 0.75) - quantile_disc(x, 0.25) AS width
           FROM folds f JOIN single s ON s.user_id % 5 <> f.fold GROUP BY f.fold),
         slopes AS (
           SELECT fold, mx, my,
                  sign(sxy) * greatest(abs(sxy / width) - 0.0001 * 0.4, 0) / (sxx / width / width + 0.0001 * 0.6) / width AS b0,
                  sxy * n / (sxx * n + width * width) AS b1,
                  sign(sxy) * greatest(abs(sxy / width) - 0.0001, 0) / (sxx / width / width) / width AS b2
           FROM m)
         SELECT s.user_id, s.business_id, round(my + b0 * (x - mx), 5) AS base_0, round(my + b1 * (x - mx), 5) AS base_1,
                round(my + b2 * (x - mx), 5) AS base_2
         FROM single s JOIN slopes ON s.user_id % 5 = slopes.fold""",
)
ORACLE["mutual_friends_filtered"] = ORACLE["mutual_friends"]
